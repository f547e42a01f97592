"""Canonical values: prompts, digests, identities and the predicates on single rows."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters at which Python splits text.
BLANKS = "[\\x09-\\x0d\\x1c-\\x20\\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
#: Winners that stand for no choice.
NO_WINNER = ("", "none", "null", "nan")
UUID_TEXT = "[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}"


#: Texts that are Python strings at one time.
COMPOSED = 256


def composed(texts: pa.Array, rows: int = COMPOSED) -> pa.Array:
    """NFC of texts; ASCII runs stay in Arrow, others become Python strings a few at a time."""
    out = []
    for k in range(0, len(texts), rows):
        some = texts.slice(k, rows)
        if pc.all(pc.string_is_ascii(some)).as_py() is False:
            some = pa.array((t if t is None or t.isascii() else unicodedata.normalize("NFC", t) for t in (x.as_py() for x in some)), texts.type)
        out.append(some)
    return pa.concat_arrays(out) if out else texts


@F.arrow_udf(T.StringType())
def nfc(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for some in texts:
        yield composed(some)


def normalize_prompt(text: Column, compose: bool = True) -> Column:
    """NFC and single spaces; case and punctuation stay.  compose=False leaves out the one
    step that needs Python, for text known to be composed."""
    one = nfc(text) if compose else text
    return F.regexp_replace(F.regexp_replace(one, f"{BLANKS}+", " "), "^ | $", "")


def json_string(text: Column) -> Column:
    """The JSON form of a string; null is 'null'."""
    made = F.to_json(F.array(text))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.substr(made, F.lit(2), F.length(made) - 2))


def digest_text(text: Column) -> Column:
    return F.sha2(json_string(text), 256)


def digest_list(values: Column) -> Column:
    return F.sha2(F.to_json(values), 256)


def prompt_group(text: Column, compose: bool = True) -> Column:
    return digest_text(normalize_prompt(text, compose))


def clean_number(x: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def whole_number(x: Column) -> Column:
    """A finite integral number as bigint, else null."""
    v = x.try_cast("double")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 9e15) & (v == F.floor(v))
    return F.when(ok, v.cast("bigint"))


def no_winner(x: Column) -> Column:
    return x.isNull() | F.lower(F.trim(x)).isin(*NO_WINNER)


def hyphenated(hex32: Column) -> Column:
    h = F.regexp_replace(F.lower(hex32), "-", "")
    return F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def path_stem(path: Column) -> Column:
    name = F.regexp_extract(path, "([^/]*)/*$", 1)
    return F.regexp_replace(name, "^(.+)\\.[^.]*$", "$1")


def source_uid(value: Column) -> Column:
    """A bare UUID, or that of a URL's last path part; else null."""
    path = F.regexp_extract(value, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    stem = F.when(value.contains("://"), path_stem(path)).otherwise(value)
    return F.when(F.lower(stem).rlike(f"^{UUID_TEXT}$"), hyphenated(stem))


def safe_member(name: Column) -> Column:
    """Relative, without parent parts, backslashes or drive letters."""
    return ~(name.startswith("/") | name.contains("\\") | name.rlike("(^|/)\\.\\.(/|$)") | name.rlike("^[A-Za-z]:"))


def identity_violation(df: DataFrame, archive: str, original: str, keys=("negative_prompt", "model_id", "image_id", "seed", "idx")) -> Column:
    """The first identity check that a joined row fails, null if none; structs archive and original."""
    a, o = F.col(archive), F.col(original)
    have = {f.name for f in df.schema[archive].dataType} & {f.name for f in df.schema[original].dataType}
    out = F.when(~source_uid(a["url"]).eqNullSafe(o["uid"]), "uid").when(~normalize_prompt(a["prompt"], False).eqNullSafe(normalize_prompt(o["prompt"], False)), "prompt")
    for k in keys:
        if k in have:
            out = out.when(o[k].isNotNull() & ~a[k].eqNullSafe(o[k]), k)
    return out


def negatives_compatible(prompts: Column) -> Column:
    """All unknown, or all known with one normalized value (an array of normalized prompts)."""
    known = F.filter(prompts, lambda x: x.isNotNull())
    return (F.size(known) == 0) | ((F.size(known) == F.size(prompts)) & (F.size(F.array_distinct(known)) == 1))


def public_metadata(fields=("model_id", "gs", "steps", "scheduler_cls", "width", "height")) -> Column:
    return F.struct(*fields)
