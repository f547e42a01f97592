"""Chat formatting, web pages and archives."""

import hashlib
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from tessella.llm import chat, html_extract, queries, warc
from tessella.llm.workspace import Workspace

SF = "/root/testdata/sf0.001"
NASTY = ["", "\\", "<|end|>\n", "\\<|user|>\n\\l\\b\\\\l", r"\### Assistant: </turn> ok", "a|>b", "ñ\u2028😀\n", "<" * 5]


def test_template_round_trip(spark):
    turns = [[(r, t) for r in ("user", "assistant", "a|>\\<") for t in NASTY], [("assistant", "")], []]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(turns)], "id long, turns array<struct<role:string,text:string>>")
    out = df.withColumn("f", chat.format_turns(F.col("turns"))).withColumn("back", chat.parse_formatted(F.col("f"))).withColumn("spans", chat.loss_spans(F.col("turns")))
    for r in out.collect():
        assert [tuple(x) for x in r.back] == turns[r.id]
        for (start, length), text in zip(r.spans, [t for role, t in turns[r.id] if role == "assistant"], strict=True):
            assert r.f[start : start + length].replace("\\l", "<").replace("\\b", "\\") == text


def test_layouts(spark):
    want = [("user", "q"), ("assistant", "a")]
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "extra": {"role": 1}},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "q", "output": "a", "n": 3},
        {"prompt": "q", "completion": "a"},
        {"prompt": "q", "response": "a", "z": [1, 2]},
        {"question": "q", "answer": "a"},
    ]
    rows = [(k, json.dumps(x)) for k, x in enumerate(records)] + [(90, "{"), (91, '{"other": 1}'), (92, None)]
    got = {r.id: r for r in chat.canonical_turns_json(spark.createDataFrame(rows, "id long, j string"), "id", "j").collect()}
    for k in range(len(records)):
        assert [tuple(t) for t in got[k].turns] == want, records[k]
    assert all(got[k].turns is None for k in (90, 91, 92))
    more = [(0, json.dumps({"instruction": "q", "input": "i", "output": "a", "system": "s"}))]
    one = chat.canonical_turns_json(spark.createDataFrame(more, "id long, j string"), "id", "j").first()
    assert [tuple(t) for t in one.turns] == [("system", "s"), ("user", "q\n\ni"), ("assistant", "a")]


def test_table_layouts(spark):
    df = spark.createDataFrame([(1, [("user", "q"), (None, None)], "x")], "id long, messages array<struct<role:string,content:string>>, note string")
    assert [tuple(t) for t in chat.canonical_turns(df, "id").first().turns] == [("user", "q"), ("", "")]
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.range(1), "id")


def test_chat_query(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    turns = {}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)):
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    turns[-7] = [("user", NASTY[4]), ("assistant", NASTY[4])]
    got = {r.conv_id: r for r in queries.op5_chat_format(spark, SF).collect()}
    assert got.keys() == turns.keys()
    for k, t in turns.items():
        loss = "".join(x for role, x in t if role == "assistant")
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in t).encode()).hexdigest()
        assert (got[k].n_turns, got[k].loss_chars, got[k].loss_sha256) == (len(t), len(loss), hashlib.sha256(loss.encode()).hexdigest())


PAGE = """<!DOCTYPE html><html><head><title>No &amp; no</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="post">
<header><h2>Site</h2></header><nav><ul><li><a href=/>Home</a><li>Two</ul></nav><!-- <p>gone</p> --><div class="ad">Buy</div>
<div class="cookie-notice">We bake</div><{tag}><h1>Title {n}</h1><p>One &lt;b&gt; &amp;amp; {n}
 <b>two</b><br>three<p>Second   para {n}<div class="share">Share</div><ul><li>x<li>y{n}</ul>{extra}</{end}>
<aside>Aside</aside><form>Mail <input></form><div id="comments"><p>Nice!</p></div><footer>&copy;</footer>"""


@pytest.mark.parametrize("tag", ["article", 'div class="content"', "main"])
def test_wrapper_extraction(spark, tag):
    pages = [(k, f"http://h{k % 2}.org/p/{k}", PAGE.format(tag=tag, end=tag.split()[0], n=k, extra="<blockquote>q</blockquote>" if k % 3 == 0 else "")) for k in range(12)]
    pages += [(100, None, None), (101, "http://h0.org", ""), (102, "http://x.org", "plain <text"), (102, "http://x.org", "plain <text")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in html_extract.extract_pages(df).collect()}
    for k in range(12):
        blocks = [f"Title {k}", f"One <b> &amp; {k} two three", f"Second para {k}", "x", f"y{k}"] + ["q"] * (k % 3 == 0)
        assert got[k].text == "\n\n".join(blocks) and got[k].n_chars == len(got[k].text)
    assert (got[100].text, got[101].text, got[102].text) == ("", "", "plain")
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def test_wrapper_is_union_free():
    a, b, c = (html_extract.wrapper(html_extract.parse(h)) for h in ("<div><h1>T</h1><p>1</div>", "<div><h1>T</h1><p>2<p>3<ul><li>4</ul></div>", "<div><h1>U</h1></div>"))
    w = html_extract.align(html_extract.align(a, b), c)
    div = w[4][0]
    assert [(x[0], x[1]) for x in div[4]] == [("h1", "1"), ("p", "*"), ("ul", "?")]
    assert div[4][0][4][0][3] == -1 and w[2] == 3
    ab = html_extract.align(a, b)
    assert ab[4][0][4][0][4][0][3] not in (None, -1)


def test_joined_wrappers_equal_broadcast_ones(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    one = {tuple(r) for r in html_extract.extract_pages(df).collect()}
    monkeypatch.setattr(html_extract, "MAX_BROADCAST_WRAPPERS", 0)
    assert {tuple(r) for r in html_extract.extract_pages(df).collect()} == one


def test_archives(spark):
    big = "<p>é" + "x" * 1200
    rows = [(1, "http://a/\r\n", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "ü", big + "!"), (7, "v", big + "!"), (8, "w", "\x00\r\n\r\nWARC/1.1 " * 200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(tuple(r) for r in warc.archive_pages(spark, df).collect())
    want = []
    for k, _, h in rows:
        raw = (h or "").encode()
        first = max(i for i, _, x in rows if x == h) if len(raw) >= 1000 else k
        want.append((k, len(raw), hashlib.sha1(raw).hexdigest(), "response" if first == k else "revisit", None if first == k else first))
    assert got == sorted(want, key=lambda x: (x[0], x[1]))
    assert warc.archive_pages(spark, df.limit(0)).count() == 0


def test_reader_splits_anywhere():
    r = random.Random(1)
    import zlib

    data, starts = b"", []
    for k in range(40):
        body = bytes(r.randrange(256) for _ in range(r.randint(0, 300))) + warc.MAGIC * r.randint(0, 3)
        z = zlib.compressobj(r.choice((0, 6)), zlib.DEFLATED, 31)
        starts.append(len(data))
        data += z.compress(warc.record(k, "u", body, hashlib.sha1(body).hexdigest(), "response", None)) + z.flush()
        if k == 20:
            data += b"damage\x1f\x8b\x08junk"
    for split in (1, 37, 256, 4000, len(data)):
        seen = []
        for a in range(0, len(data), split):
            got = [warc._page(f["warc-record-id"]) for f, _ in warc.records_in(io.BytesIO(data), len(data), a, min(len(data), a + split))]
            assert got == [k for k, s in enumerate(starts) if a <= s < a + split]
            seen += got
        assert seen == list(range(40))


def test_written_files_are_bounded(spark):
    ws = Workspace(spark, "warc_test")
    df = warc.plan_records(spark.createDataFrame([(k, "u", str(k) * 500) for k in range(60)], "page_id long, url string, html string")).coalesce(1)
    files = ws.write(warc.write_archives(df, ws.path("a"), 2000), "files")
    assert files.count() > 3
    assert warc.read_archives(files, 700).count() == 60
    ws.close()


def _rows(spark, pages):
    return spark.createDataFrame(pages, "page_id long, url string, html string")


def test_host_wrapper_decides(spark):
    """The pages of a host tell its furniture: a page alone has another text."""
    page = '<body><div class="left">{menu}</div><div class="x"><h1>T{n}</h1><div class="share-story">{note}</div><p>body {n} and a longer text{n}</p><div class="q">All rights reserved</div></div></body>'
    pages = [(k, "http://h.org/", page.format(n=k, menu="<p>Home<p>News", note=f"story {k}")) for k in range(6)]
    pages += [(50 + k, "http://still.org/", page.format(n=k, menu="<p>Home", note="Share this")) for k in range(3)]
    got = {r.page_id: r.text for r in html_extract.extract_pages(_rows(spark, pages)).collect()}
    alone = {}
    for k, _, h in pages:
        root = html_extract.parse(h)
        alone[k] = html_extract.extract(root, html_extract.read_plan(json.dumps(html_extract.plan_of(html_extract.wrapper(root)))))
    for k in range(6):
        assert got[k] == f"T{k}\n\nstory {k}\n\nbody {k} and a longer text{k}"
        assert alone[k] == f"T{k}\n\nbody {k} and a longer text{k}\n\nAll rights reserved"
    assert got[50] == "T0\n\nbody 0 and a longer text0"  # a constant block with a telling name


def test_wrapper_does_not_depend_on_partitions(spark):
    r = random.Random(3)
    parts = ["<nav>m</nav>", '<div class="a">A</div>', '<div class="b"><p>{n}</div>', "<section><h2>{n}</h2><p>t{n}</section>", "<ul><li>{n}<li>x</ul>", '<div class="share">{n}</div>', "plain{n}", "<p>always</p>"]
    pages = [(k, f"http://h{k % 2}.org/", "<body>" + "".join(r.sample(parts, 5)).format(n=k) + "</body>") for k in range(60)]
    df = _rows(spark, pages)
    results = [{tuple(x) for x in html_extract.extract_pages(df.repartition(n)).collect()} for n in (1, 3, 17)]
    assert results[0] == results[1] == results[2]


def test_deep_and_wide_pages(spark):
    deep = "<div>" * 20_000 + "<p>bottom"
    wide = "<article>" + "".join(f'<div class="c{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}"><p>{k}</div>' for k in range(3000))
    pages = [(1, "http://d.org", deep), (2, "http://d.org", deep.replace("bottom", "ground")), (3, "http://w.org", wide), (None, "http://w.org", wide + "<p>end"), (4, "http://w.org", None)]
    got = {x.page_id: x.text for x in html_extract.extract_pages(_rows(spark, pages).withColumn("text", F.lit("clash"))).collect()}
    assert (got[1], got[2], got[4]) == ("bottom", "ground", "")
    assert got[3].split("\n\n") == [str(k) for k in range(3000)] and got[None].endswith("2999\n\nend")


def test_packed_wrappers():
    w = html_extract.wrapper(html_extract.parse("<div><p>1<p>2<ul><li>3</ul></div><div class=a>4</div>"))
    assert html_extract.unpack(html_extract.pack(w)) == w


def test_archives_with_odd_rows(spark):
    """Null ids, clashing columns, and a read in as many tasks as there are ranges."""
    big = "y" * 1500
    rows = [(None, None, big), (None, "u", big), (3, "u", big), (None, "v", "small")]
    df = _rows(spark, rows).withColumn("digest", F.lit(1)).withColumn("record_type", F.lit("x"))
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_pages(spark, df).collect())
    assert got == [("3", 1500, "response", None), ("None", 5, "response", None), ("None", 1500, "revisit", 3), ("None", 1500, "revisit", 3)]
    alone = warc.archive_pages(spark, df.where("page_id is null")).collect()
    assert {(r.record_type, r.refers_to) for r in alone} == {("response", None)}
    ws = Workspace(spark, "warc_ranges")
    files = ws.write(warc.write_archives(warc.plan_records(_rows(spark, [(k, "u", "".join(map(str, range(k, k + 900)))) for k in range(60)])), ws.path("a")), "files")
    read = ws.write(warc.read_archives(files, 1000), "read")
    tasks = len({r[0] for r in read.select(F.input_file_name()).distinct().collect()})
    assert read.count() == 60 and tasks > 15
    ws.close()


def test_roles_stay_and_extra_columns(spark):
    df = spark.createDataFrame([(1, 0, "human", "q", "z"), (1, 1, "bot", None, "z"), (1, None, None, "n", "z")], "conv_id long, turn int, role string, text string, turns string")
    got = chat.canonical_turns(df, "conv_id").first()
    assert [tuple(t) for t in got.turns] == [("", "n"), ("human", "q"), ("bot", "")]
    assert chat.canonical_turns(df.limit(0), "conv_id").count() == 0


def test_masked_texts(spark):
    turns = [[("assistant", t) for t in NASTY] + [("user", "u")] + [("assistant", t) for t in reversed(NASTY)]]
    df = spark.createDataFrame([(0, turns[0])], "id long, turns array<struct<role:string,text:string>>")
    row = df.select(chat.masked_texts(chat.format_turns(F.col("turns")), chat.loss_spans(F.col("turns"))).alias("t")).first()
    assert row.t == NASTY + NASTY[::-1]
