"""Greedy word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie with failure links (Song et al., 2021).  Each node knows the node
reached after the longest-match pieces of its string are popped, and how many pieces those
are, so the number of pieces of a word comes from one walk over its bytes: no piece is built
and no byte is read twice.

Pieces that carry the mark of a word's end match there only, and the others only before it: a
word's last byte counts as a symbol of its own (256 more than the byte), and so does the last
byte of a marked piece.  Words recur, so workers keep the counts of words seen, by their bytes,
in a table of bounded size.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_WORDS = 500_000
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"


def byte_symbols() -> dict[str, int]:
    """The public byte-to-character map of byte-level vocabularies: printable Latin-1 bytes
    stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def load_pieces(path: str = VOCABULARY, end_mark: str = "</w>") -> tuple[set[bytes], None, set[bytes]]:
    """Pieces of a tokenizer file's vocabulary as bytes: those without the mark of a word's end,
    no others for inside a word, and those with the mark."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    symbols = byte_symbols()
    plain: set[bytes] = set()
    final: set[bytes] = set()
    for token in vocab:
        bare = token.removesuffix(end_mark)
        if bare and all(c in symbols for c in bare):
            (plain if bare == token else final).add(bytes(symbols[c] for c in bare))
    return plain, None, final


class Automaton:
    """Longest-match automaton over pieces that start a word and pieces that continue one.

    Without ``inner`` every piece may start or continue a word.  With ``final`` those pieces,
    and no others, end a word (and may be all of it).  A word that cannot be cut into pieces
    whole counts as one unknown piece.
    """

    def __init__(self, pieces: set[bytes], inner: set[bytes] | None = None, final: set[bytes] | None = None):
        self.edge: dict[int, int] = {}  # node * 512 + symbol -> node
        self.marked = final is not None
        ends: set[int] = set()
        count = 2  # 0: before a word, 1: inside a word
        for root, words in ((0, pieces), (1, pieces if inner is None else inner)):
            for last, some in ((0, words), (256, final or ())):
                for w in sorted(some):
                    v = root
                    for b in (*w[:-1], w[-1] + last):
                        key = v * 512 + b
                        nxt = self.edge.get(key)
                        if nxt is None:
                            nxt = self.edge[key] = count
                            count += 1
                        v = nxt
                    ends.add(v)
        self.fail = [-1] * count
        self.popped = [0] * count
        children: dict[int, list[tuple[int, int]]] = {}
        for key, v in self.edge.items():
            children.setdefault(key >> 9, []).append((key & 511, v))
        level = [0, 1]
        while level:
            following = []
            for u in level:
                for b, v in children.get(u, ()):
                    following.append(v)
                    if v in ends:
                        self.fail[v], self.popped[v] = 1, 1
                        continue
                    z, n = self.fail[u], self.popped[u]
                    while z >= 0 and z * 512 + b not in self.edge:
                        n += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.edge[z * 512 + b], n
            level = following

    def count(self, word: bytes) -> int:
        """Pieces of a non-empty word; -1 if it cannot be cut."""
        edge, fail, popped = self.edge, self.fail, self.popped
        v, n = 0, 0
        for b in (*word[:-1], word[-1] + 256) if self.marked else word:
            nxt = edge.get(v * 512 + b)
            while nxt is None:
                n += popped[v]
                v = fail[v]
                if v < 0:
                    return -1
                nxt = edge.get(v * 512 + b)
            v = nxt
        while v > 1:
            n += popped[v]
            v = fail[v]
        return n if v == 1 else -1


_UNKNOWN = 1 << 40


class _Memo(dict):
    """Pieces of each word seen; an unknown word counts 1 and once above _UNKNOWN."""

    def __init__(self, machine: Automaton):
        super().__init__()
        self.machine = machine

    def __missing__(self, word: bytes) -> int:
        n = self.machine.count(word)
        n = self[word] = n if n >= 0 else 1 + _UNKNOWN
        return n


def token_counts(docs: DataFrame, automaton: Automaton, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_tokens, n_unknown.

    Words are runs outside ``[\\x20\\x09-\\x0D]`` of the whole text, A-Z lower-cased.  Unknown
    words count as one token each.  Null and empty texts have no words, a null id stays null.
    Repeated rows are counted each time; an empty table gives no rows; extra columns are ignored.
    The automaton's size is that of the vocabulary, which does not grow with the documents.
    """
    shared = docs.sparkSession.sparkContext.broadcast(automaton)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fold = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Memo(shared.value)
        for batch in batches:
            words, total = [], []
            for text in batch.column("text").cast(pa.binary()):
                # bytes.split() cuts at exactly these six bytes
                got = (text.as_py() or b"").translate(fold).split()
                words.append(len(got))
                total.append(sum(map(known.__getitem__, got)))
                if len(known) > CACHE_WORDS:
                    known.clear()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words, pa.int64()), pa.array([t % _UNKNOWN for t in total], pa.int64()), pa.array([t // _UNKNOWN for t in total], pa.int64())],
                names=["doc_id", "n_words", "n_tokens", "n_unknown"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_tokens bigint, n_unknown bigint")
