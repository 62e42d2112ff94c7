"""The ten operators and the pipeline against brute force, round trips and held-out accuracy, with awkward rows."""

import base64
import hashlib
import itertools
import os
import pathlib
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mosaiq.llm import blocks, graph, langid, neighbours, packing, quality, queries, setjoin, substring, tiling, tokencount, warc, words
from mosaiq.llm.common import Scratch

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def made(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghiklmnoprstuv"), rng.integers(2, 8))) for _ in range(n))


def frame(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], schema)


AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "!!! 123"), (5, "one"), (5, "one"), (None, "a lost row of words here"), (6, "word " * 30000), (7, "é́ ﬁ ß İ 日本語 \x00")]


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        inter = len(sets[a] & sets[b])
        if inter and 100 * inter >= 80 * (len(sets[a]) + len(sets[b]) - inter):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(12):
        base = made(1000 + g, int(rng.integers(6, 260))).split()
        for _ in range(int(rng.integers(1, 9))):
            w = base.copy()
            for _ in range(int(rng.integers(0, max(2, len(w) // 14)))):
                w[int(rng.integers(len(w)))] = made(int(rng.integers(1e9)), 1)
            rows.append(" ".join(w))
    return list(enumerate(rows + [made(5000 + k, 80) + " shared line of the corpus that all of these documents hold in common" for k in range(30)]))


def test_jaccard_components_equal_brute_force(spark):
    rows = near_copies(1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.jaccard_components(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def chained_copies(seed):
    """Groups in which neighbours are near and ends are not: many links that no pivot sees, and many near misses."""
    rng, rows = np.random.default_rng(seed), []
    for g in range(6):
        w = made(3000 + g, int(rng.integers(90, 400))).split()
        for _ in range(25):
            rows.append(" ".join(w))
            w = w.copy()
            for at in rng.choice(len(w), max(1, len(w) // int(rng.integers(40, 60))), replace=False):
                w[at] = made(int(rng.integers(1e9)), 1)
    order = rng.permutation(len(rows))
    return [(int(i), rows[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize("seed", [3, 4])
def test_jaccard_of_chains_with_small_lots(spark, monkeypatch, seed):
    """Long lists cut into lots, pivots' partners into tasks of two."""
    monkeypatch.setattr(setjoin, "LONG", 3)
    monkeypatch.setattr(setjoin.differences, "__defaults__", (2,))
    rows = chained_copies(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.jaccard_components(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_scratch_tables_leave_no_shuffle_files(spark):
    """What a scratch table was made from is gone from the disk once the table is written."""
    held = lambda: {f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = held(), spark.conf.get(key)
    out = Scratch(spark, "test").save(spark.range(10000).repartition(5, "id").groupBy((F.col("id") % 10).alias("k")).count(), "counts")
    deadline = time.monotonic() + 10  # the files are deleted in the background
    while held() - before and time.monotonic() < deadline:
        time.sleep(0.2)
    assert not held() - before
    assert out.count() == 10 and spark.conf.get(key) == setting


def test_jaccard_on_awkward_rows(spark):
    df = frame(spark, AWKWARD).withColumn("n_shingles", F.lit("clash")).withColumn("component", F.lit(1)).withColumn("bucket", F.lit(2))
    rows = setjoin.jaccard_components(df).collect()
    assert len(rows) == len(AWKWARD)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[3] == (0, 3) and got[5] == (1, 5) and got[6] == (1, 6) and got[None] == (2, None)
    assert setjoin.jaccard_components(frame(spark, [])).count() == 0


def test_least_overlap_and_bitmaps():
    for n, m in itertools.product(range(1, 60), repeat=2):
        want = next(o for o in range(0, n + m + 1) if 100 * o >= 80 * (n + m - o))
        assert setjoin.least_overlap(n, m, 80) == want
    a, b = (np.unique(words.mix(np.arange(k, k + 200).astype(np.uint64))) for k in (0, 30))
    apart = np.bitwise_count(np.frombuffer(setjoin.parity(a), np.uint8) ^ np.frombuffer(setjoin.parity(b), np.uint8)).sum()
    assert apart <= 60
    assert setjoin.overlap(a, b) == 170


def test_words_follow_the_pattern():
    texts = ["Ab  c\td\x0be", "", "É x", "one two three four five six seven", "  lead and trail  "]
    w = words.segment([t.encode() for t in texts])
    got = [[w.bytes_of(k).decode() for k in range(w.first[i], w.first[i + 1])] for i in range(len(texts))]
    assert got == [WORD.findall(t.translate(LOWER)) for t in texts]
    h, first = words.shingles(w)
    assert np.diff(first).tolist() == [1, 0, 1, 3, 1]
    again, _ = words.shingles(words.segment([texts[3].encode()]))
    assert (h[first[3] : first[4]] == again).all()


def test_components_both_ways(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 10), (5, 5), (3, 1), (20, 21), (21, 22), (22, 23), (23, 24)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    want = {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 10: 7, 5: 5, 20: 20, 21: 20, 22: 20, 23: 20, 24: 20}
    for few in (100, 0):
        got = {r.node: r.component for r in graph.components(df, Scratch(spark, "t"), few=few).collect()}
        assert got == want
    assert graph.components(df.where("a > 99"), Scratch(spark, "t")).count() == 0


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "u", b"a" * 70000), (2, "v", b"a" * 70000), (3, None, None), (4, "w", b""), (None, "z", b"q"), (5, "x\r\ny", b"WARC/1.1\r\n\r\n" * 9000), (6, "é", "é\n".encode()), (6, "é", b"other")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, payload binary").withColumn("sha", F.lit(1)).repartition(3)
    warc.write_warc(df, str(tmp_path / "w"), segment=4096, chunk=1000)
    got = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes, r.digest, r.payload and bytes(r.payload), r.error) for r in warc.read_warc(spark, str(tmp_path / "w")).collect())
    sha = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    first = {}
    for i, _, p in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if i is not None:
            first.setdefault(p or b"", i)
    want = []
    for i, _, p in rows:
        p = p or b""
        rev = i is not None and first[p] != i
        want.append((i or 0, "revisit" if rev else "response", first[p] if rev else None, len(p), sha(p), None if rev else p, None))
    assert sorted(map(str, got)) == sorted(map(str, want))
    named = {r.record_id for r in warc.read_warc(spark, str(tmp_path / "w")).collect() if r.record_type == "response"}
    text = "".join(r.value for r in spark.read.text(str(tmp_path / "w"), wholetext=True).collect())
    refers = set(re.findall(r"WARC-Refers-To: (\S+)", text))
    assert refers and refers <= named
    warc.write_warc(df.limit(0), str(tmp_path / "e"))
    assert warc.read_warc(spark, str(tmp_path / "e")).count() == 0


def test_head_without_an_end_tag():
    page = "<html><head><title>T</title><meta charset=utf-8><body><article><p>Hello there, this is text.<p>More of it.</article></html>"
    assert [b[1] for b in blocks.leaves(page)] == ["Hello there, this is text.", "More of it."]
    assert [b[1] for b in blocks.leaves("<head><script>x</script><style>y</style><div>one</div>two")] == ["one", "two"]
    assert [b[1] for b in blocks.leaves("<head><noscript><p>no</p></noscript><title>no</title></head><body>yes")] == ["yes"]


def test_letters_of_the_last_planes():
    assert len(langid.trigrams(chr(0x32010) * 3)) == 3 and not len(langid.trigrams("123 !"))


def test_segments_and_framing():
    data = bytes(range(256)) * 20
    assert warc.unchunked(warc.chunked(data, 777)) == data and warc.unchunked(warc.chunked(b"", 5)) == b""
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")
    assert warc.assembled([(1, None, b"ab"), (2, 3, b"c")]) == (b"abc", None)
    assert warc.assembled([(1, None, b"ab"), (3, 3, b"c")])[0] is None and warc.assembled([(1, None, b"ab"), (2, 9, b"c")])[0] is None
    import gzip

    two = gzip.compress(warc.record("response", [], b"x")) + gzip.compress(warc.record("revisit", [], b""))
    assert [h["warc-type"] for h, _ in warc.parsed(warc.unzipped(two))] == ["response", "revisit"]
    assert [b for _, b in warc.parsed(b"WARC/1.1\r\nContent-Length: 999\r\n\r\nxx" + warc.record("response", [], b"ok"))] == [b"ok"]


def test_cartesian_windows_equal_brute_force():
    rng = np.random.default_rng(3)
    g = rng.integers(0, 50, 120).astype(np.uint64)
    first, t = np.array([0, 40, 44, 120]), 7
    got = set(zip(*(x.tolist() for x in substring.compact_windows(g, first, t)), strict=True))
    want = set()

    def split(k, lo, hi):
        if hi - lo < t:
            return
        c = lo + int(np.argmin(g[first[k] + lo : first[k] + hi]))
        want.add((k, c, lo, hi - 1))
        split(k, lo, c)
        split(k, c + 1, hi)

    for k in range(3):
        split(k, 0, first[k + 1] - first[k])
    assert got == want


def test_repeated_passages(spark):
    passage, near = made(7, 60), made(8, 70).split()
    other = near.copy()
    other[35] = "changed"
    rows = [(1, made(10, 90) + " " + passage + " " + made(11, 40)), (2, made(12, 30) + " " + passage + " " + made(13, 80)), (3, made(14, 200)), (4, made(15, 20) + " " + " ".join(near)), (5, " ".join(other) + " " + made(16, 20)), (6, made(14, 200)), (7, made(17, 20)), (8, None), (9, "")]
    got = substring.repeated_passages(frame(spark, rows).withColumn("a", F.lit(1)).withColumn("spans", F.lit(2)))
    spans = {}
    for r in got.collect():
        spans.setdefault(r.doc_id, []).append((r.start, r.end, r.source_id))
    assert set(spans) == {2, 5, 6}
    assert any(s <= 30 and e >= 90 and b == 1 for s, e, b in spans[2]) and any(s == 0 and e == 200 and b == 3 for s, e, b in spans[6])
    kept = {r.doc_id: r for r in substring.without_repeats(frame(spark, rows), got).collect()}
    assert set(kept) == {1, 2, 3, 4, 5, 7, 8, 9} and passage not in kept[2].text and kept[2].n_chars == len(kept[2].text)
    assert kept[1].text == rows[0][1] and kept[8].text is None and kept[2].text.startswith(made(12, 30)) and kept[2].text.endswith(made(13, 80))
    assert substring.repeated_passages(frame(spark, [])).count() == 0
    assert substring.repeated_passages(frame(spark, AWKWARD)).count() == 0


def test_contexts_lie_in_every_range():
    for t in (1, 2, 7, 46, 96):
        around = substring.contexts(t)
        assert all(any(i <= w and j <= t - 1 - w for i, j in around) for w in range(t))


def test_passages_that_share_a_template(spark):
    """Fields of their own inside a common text, three exact copies each: later copies are found with their own source."""
    before, after = made(900, 20), made(901, 20)
    passages = [f"{before} {made(910 + v, 14)} {after}" for v in range(20)]
    rows = [(20 * k + v, f"{made(2000 + 20 * k + v, 15)} {passages[v]} {made(3000 + 20 * k + v, 15)}") for k in range(3) for v in range(20)]
    rows.append((-1, f"{made(4000, 30)} {after} {made(4001, 60)} {passages[3]} {made(4002, 9)} {before} {made(4003, 60)}"))  # the template's parts in other places too
    got = {}
    for r in substring.repeated_passages(frame(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.source_id))
    late = [d for d in range(20, 60)] + [3]
    lost = [d for d in late if not any(s <= 17 and e >= 67 and (b % 20 == d % 20 or (b, d % 20) == (-1, 3)) for s, e, b in got.get(d, []))]
    assert not lost, lost


@pytest.mark.parametrize("period", [1, 2, 3])
@pytest.mark.parametrize("lots", [1, 14])
def test_runs_of_repeated_words(spark, period, lots):
    """Words said over and over: shorter runs in documents between don't hide the run that is repeated."""
    said = lambda n: " ".join(("ta", "ke", "ro")[k % period] for k in range(n))
    rows = [(1, f"{made(1, 60)} {said(55)} {made(2, 60)}")] + [(k, f"{made(10 * k, 70)} {said(30 + k)} {made(10 * k + 1, 70)}") for k in range(2, 14)] + [(20, f"{made(3, 60)} {said(80)} {made(4, 60)}")]
    got = substring.repeated_passages(frame(spark, rows).repartition(lots, "doc_id")).where("doc_id = 20").collect()
    assert set(range(60, 140)) <= {w for r in got for w in range(r.start, r.end)}


@pytest.mark.parametrize("lots", [1, 9])
def test_near_copies_behind_a_template(spark, lots):
    """24 words that all documents hold don't hide the two that hold them in nearly the same passage."""
    template, rows = made(5000, 24), []
    for v in range(100):
        own = made(5100 + v, 30).split()
        other = own.copy()
        other[14] = "changed"
        for k, w in enumerate((own, other)):
            rows.append((100 * k + v, f"{made(6000 + 2 * v + k, 60)} {' '.join(w[:17])} {template} {' '.join(w[17:])} {made(7000 + 2 * v + k, 60)}"))
    got = {}
    for r in substring.repeated_passages(frame(spark, rows).repartition(lots, "doc_id")).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.source_id))
    assert all(100 <= d and b == d - 100 for d in got for _, _, b in got[d])
    assert sum(any(s <= 64 and e >= 110 for s, e, _ in x) for x in got.values()) >= 97


def test_language_tables_go_with_their_task(spark):
    """Workers that are used again by later stages don't hold the vectors of trigrams any more."""
    docs = frame(spark, [(k, made(k, 40)) for k in range(8)]).withColumn("lang", F.lit("x"))
    assert langid.predict_languages(docs, langid.fit_languages(docs)).count() == 8

    def left(batches):
        from mosaiq.llm import langid as own

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([sum(isinstance(x, own.Space) for x in own._tables.values())] * b.num_rows, pa.int64())})

    assert spark.range(64, numPartitions=8).mapInArrow(left, "n bigint").agg(F.sum("n")).first()[0] == 0


@pytest.mark.parametrize("changes", [1, 4])
def test_many_near_copies_in_few_rows(spark, changes):
    """Each of many near copies is covered as by all earlier ones together, without a row for each pair of them."""
    rng, base, rows = np.random.default_rng(changes), made(8000, 120).split(), []
    for v in range(150):
        own = base.copy()
        for k in rng.choice(120, changes, replace=False):
            own[k] = f"x{v}y{k}"
        rows.append((v, f"{made(8100 + v, 40)} {' '.join(own)} {made(8300 + v, 40)}"))
    rows.append((1000, " ".join(made(8600 + k, 30) + " " + " ".join(base[50:58]) for k in range(5))))
    hashes = [words.shingles(words.segment([text.encode()]))[0] for _, text in rows]
    want = {(a, w) for a in range(150) for b in range(a) for lo, hi in substring.shared_spans(hashes[a], hashes[b], 46, 80) for w in range(lo, hi + 4)}
    found = substring.repeated_passages(frame(spark, rows).repartition(9, "doc_id")).collect()
    got = {(r.doc_id, w) for r in found for w in range(r.start, r.end)}
    assert got <= want and len(want & got) >= 0.98 * len(want)
    assert len(found) <= 8 * len(rows)


def test_every_place_of_a_repeated_passage(spark):
    """A document that holds a passage of another task's lot three times loses it at all three places."""
    passage = made(5, 60)
    rows = [(1, f"{made(1, 80)} {passage} {made(2, 80)}"), (2, " ".join(f"{made(10 + k, 150)} {passage}" for k in range(3)))]
    got = substring.repeated_passages(frame(spark, rows).repartitionByRange(2, "doc_id")).collect()
    assert {w for r in got for w in range(r.start, r.end)} >= {210 * k + w for k in range(3) for w in range(150, 210)} and {r.doc_id for r in got} == {2}


def test_exact_runs_against_brute_force(spark):
    """Every run of 50 words that an earlier document also holds lies in passages found, over a whole table."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").select("doc_id", "text")
    covered, earlier, runs = {}, {}, 0
    for r in substring.repeated_passages(docs).collect():
        covered.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    for r in docs.orderBy("doc_id").collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text))
        for k in range(len(w) - 49):
            if earlier.setdefault(hash(tuple(w[k : k + 50])), r.doc_id) != r.doc_id:
                runs += 1
                assert covered.get(r.doc_id, set()).issuperset(range(k, k + 50)), (r.doc_id, k)
    assert runs > 20000


def test_quality_learns(spark):
    rows = [(k, made(k, 40) if k % 2 else made(k, 40).upper().replace(" ", "!! ")) for k in range(400)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.score for r in quality.score_documents(frame(spark, rows + AWKWARD[:4]), labels, F.col("doc_id") < 200).collect() if r.doc_id >= 200}
    assert all(0 <= s <= 1 for s in got.values()) and np.mean([(s >= 0.5) == (k % 2 == 1) for k, s in got.items()]) > 0.95
    none = quality.score_documents(frame(spark, AWKWARD), labels.limit(0)).collect()
    assert len(none) == len(AWKWARD) and {r.score for r in none} == {0.5}
    assert quality.score_documents(frame(spark, []), labels).count() == 0
    assert quality.isotonic(np.array([1.0, 3, 2, 4]), np.ones(4)).tolist() == [1, 2.5, 2.5, 4]


def test_quality_held_out(spark):
    out = queries.op4_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.95


PAGE = """<html><head><title>T</title><script>if(a<b)x()</script></head><body><header><p>Site name here</p><nav><ul><li><a href=#>Home</a></li><li><a href=#>News</a></li></ul></nav></header>
<div class="cookie-notice"><p>We use cookies.</p></div><article><h1>A &amp; title</h1><p>First  paragraph,\n with words.<p>Second one &lt;here&gt;.</article>
<aside class="sidebar"><p>Related things</p></aside><form><label>Your mail</label></form><section class="comments"><h3>Comments</h3><div class="comment"><p>Nice post, thanks.</p></div></section><footer>&copy; site</footer></body></html>"""


def test_main_text(spark):
    found = blocks.leaves(PAGE)
    assert {"A & title", "First paragraph, with words.", "Second one <here>.", "Related things"} <= {b[1] for b in found}
    rows = [(1, "u", PAGE), (2, None, None), (3, "w", ""), (3, "w", ""), (None, "x", "<p>"), (4, "y", "<!DOCTYPE <![x <p>text")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit(5))
    got = {r.page_id: r for r in blocks.extract(df).collect()}
    assert got[1].text == "A & title\nFirst paragraph, with words.\nSecond one <here>." and got[1].n_chars == len(got[1].text)
    assert got[2].text == "" and got[2].url is None and got[3].n_chars == 0 and blocks.extract(df).count() == 6
    assert blocks.extract(df.limit(0)).count() == 0
    rng, wrong, total, params = np.random.default_rng(123), 0, 0, blocks.train()
    for _ in range(100):
        page, truth = blocks.made_page(rng)
        p = blocks.label(params, [blocks.leaves(page)])[0] >= 0.5
        wrong, total = wrong + (p != np.array(truth)).sum(), total + len(truth)
    assert wrong / total < 0.03


def test_near_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(20, 8))
    rows = [(k, [float(np.float32(v)) for v in base[k % 20] + rng.normal(size=8) * (0.02 if k < 60 else 1)], k % 2) for k in range(120)]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 0), (202, None, 0), (203, [0.0] * 8, 0), (204, [1.0, float("nan")] + [0.0] * 6, 0), (205, rows[1][1], None), (206, [], 1), (207, [1.0, 2.0], 1), (None, rows[0][1], 0), (208, [None] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("node", F.lit(1)).withColumn("grp", F.lit(1))
    got = {r.vec_id: r for r in neighbours.near_vectors(df, lot=16, turns=2).collect()}
    good = {i: (np.array(v, np.float32).astype(float), c) for i, v, c in rows if i is not None and v and c is not None and None not in v and np.isfinite(v).all() and any(v)}
    for i, (v, c) in good.items():
        n = sum(1 for j, (w, e) in good.items() if j != i and e == c and len(w) == len(v) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98)
        assert got[i].n_links == n, i
    assert got[200].component_id == got[201].component_id == got[0].component_id and not got[200].kept
    assert all(got[i].n_links == 0 and got[i].kept for i in (202, 203, 204, 205, 206, 208)) and got[None].component_id is None and len(got) == len(rows)
    assert neighbours.near_vectors(df.limit(0)).count() == 0


def brute_links(x):
    u = x.astype(np.float32).astype(float)
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.98
    np.fill_diagonal(near, False)
    low = np.arange(len(x))
    while True:
        new = np.minimum(low, np.where(near, low[None], len(x)).min(1))
        if (new == low).all():
            return near.sum(1), low
        low = new


def near_links_are_whole(spark, x, lot, least=1.0, **audit):
    """With an audit of all rows the result is exact; with the usual one, recall is ``least`` or more."""
    df = spark.createDataFrame([(k, [float(v) for v in row], 0) for k, row in enumerate(x.astype(np.float32))], "vec_id bigint, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.near_vectors(df, lot=lot, **audit).collect()}
    links, low = brute_links(x)
    assert sum(got[k][0] for k in got) >= least * links.sum() and all(got[k][0] <= links[k] for k in got)
    assert least < 1 or got == {k: (links[k], low[k]) for k in range(len(x))}


def test_near_vectors_around_a_hub(spark):
    """Variants of one vector that are near it, and of each other only some."""
    rng = np.random.default_rng(11)
    hub = rng.normal(size=64)
    hub /= np.linalg.norm(hub)
    off = rng.normal(size=(1500, 64))
    off -= np.outer(off @ hub, hub)
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    near_links_are_whole(spark, np.vstack([hub, 0.985 * hub + np.sqrt(1 - 0.985**2) * off]), 200, recall=1.0, sample=10**6)


def test_isolated_near_vectors(spark):
    """Pairs at 0.981 among vectors that are far from all others."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(2400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = rng.normal(size=(600, 64))
    off -= (off * x[:600]).sum(1, keepdims=True) * x[:600]
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    near_links_are_whole(spark, np.vstack([x, 0.981 * x[:600] + np.sqrt(1 - 0.981**2) * off]), 300, 0.99)


def test_tiles_and_contamination(spark):
    item, short = made(21, 40), "three little words"
    halves = " ".join(item.split()[20:]) + " " + made(22, 30) + " " + " ".join(item.split()[:20])
    docs = [(1, made(23, 100) + " " + item.upper()), (2, halves), (3, made(24, 100)), (4, " ".join(item.split()[:12]) + made(25, 50)), (5, "Three, little words!"), (6, None), (6, "")]
    items = spark.createDataFrame([(10, item), (11, short), (12, None), (13, ""), (None, item)], "item_id bigint, text string").withColumn("coverage", F.lit(1))
    for size in (1 << 24, 100):
        got = {(r.doc_id, r.item_id): r for r in tiling.contaminated(frame(spark, docs), items, block_bytes=size).collect()}
        assert set(got) == {(1, 10), (2, 10), (5, 11)} and got[2, 10].tiles == 2 and got[2, 10].coverage == 1
    assert tiling.contaminated(frame(spark, []), items).count() == 0 and tiling.contaminated(frame(spark, docs), items.limit(0)).count() == 0
    assert tiling.contaminated(frame(spark, AWKWARD), items).count() == 0


def brute_tiles(doc, item, seed):
    used_d, used_i, tiles = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and i + n not in used_d and j + n not in used_i:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < seed:
            return tiles
        tiles.append(best)
        used_d.update(range(best[1], best[1] + best[0]))
        used_i.update(range(best[2], best[2] + best[0]))


def test_greedy_tiling_equals_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(200):
        doc, item = rng.integers(0, 3, 25).tolist(), rng.integers(0, 3, 15).tolist()
        hits = [(i, j) for i in range(23) for j in range(13) if doc[i : i + 3] == item[j : j + 3]]
        got = sum(t[2] for t in tiling.tile(hits, 15, 3)) if hits else 0
        assert got == sum(t[0] for t in brute_tiles(doc, item, 3))


def test_language_id(spark):
    rng, known = np.random.default_rng(8), {"aa": made(1, 60).split(), "bb": made(2, 60).split()}  # each language has its words
    rows = [(k, " ".join(rng.choice(known[lang], 12)), lang, "s", 0) for k in range(300) for lang in [("aa", "bb")[k >= 150]]] + [(900, "x", None, "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    model = langid.fit_languages(docs.where("doc_id % 3 <> 0"))
    got = {r.doc_id: r for r in langid.predict_languages(docs.withColumn("score", F.lit(1)), model).collect()}
    assert list(model) == ["aa", "bb"] and np.mean([got[k].lang_pred == ("aa" if k < 150 else "bb") for k in range(0, 300, 3)]) > 0.97
    odd = langid.predict_languages(frame(spark, AWKWARD), model).collect()
    assert len(odd) == len(AWKWARD) and {r.lang_pred for r in odd if r.doc_id in (1, 2, 3, 4)} == {"und"} and all(0 <= r.score <= 1 for r in odd)
    assert langid.fit_languages(docs.limit(0)) == {} and {r.lang_pred for r in langid.predict_languages(docs.limit(3), {}).collect()} == {"und"}


def test_packing_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    odd = ["Don't stop, it's he'll,'s 'S I'M", "H̱a, É < ̸ x≮y", "a<|endoftext|>b <|startoftext|> C", "x y　Z 12ab3,4", "'''s ,'t.", "İı ΣΣσ ẞ", "\x00a\x1fb", "日本語、です。 ไทย", "́abc ́"]
    rows = AWKWARD + [(20 + k, t) for k, t in enumerate(odd)] + [(100 + k, made(k, k * 3)) for k in range(60)]
    out = packing.pack_documents(frame(spark, rows).withColumn("part", F.lit(1)).withColumn("length", F.lit(1)).repartition(3), path, 200, 1, with_ids=True).collect()
    by_doc = {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        mine = sorted(by_doc[i], key=lambda r: r.piece)
        if i != 5:
            assert sum((r.ids for r in mine), []) == ids and [r.start for r in mine] == list(range(0, len(ids), 200)), (i, t)
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) for r in mine)
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        end = 0
        for o, n in sorted(b):
            assert o == end
            end = o + n
        assert end <= 200
    assert len(bins) <= -(-sum(r.length for r in out) // 200) + 2
    assert packing.pack_documents(frame(spark, []), path).count() == 0


def test_plan_against_one_by_one():
    rng = np.random.default_rng(6)
    for _ in range(60):
        cap = int(rng.integers(6, 40))
        lengths = rng.integers(1, cap + 1, int(rng.integers(1, 80))).tolist()
        count = {n: lengths.count(n) for n in set(lengths)}
        rows, bins = packing.plan(count, cap)
        key, fill = (rows[:, 0] << 40) + rows[:, 1], {}
        for n, c in count.items():
            for rank in range(c):
                row = rows[np.searchsorted(key, (n << 40) + rank, "right") - 1]
                k = rank - row[1]
                fill.setdefault(row[2] + k // row[3], []).append((row[4] + k % row[3] * n, n))
        assert len(fill) == bins
        for b in fill.values():
            end = 0
            for o, n in sorted(b):
                assert o == end
                end = o + n
            assert end <= cap
        large = sum(1 for n in lengths if 3 * n > cap)
        assert bins >= -(-sum(lengths) // cap) and bins <= max(large, -(-3 * sum(lengths) // (2 * cap)) + 1)


@pytest.mark.parametrize("chunk,overlap", [(64, 8), (200, 16), (50, 1)])
def test_spliced_counts(chunk, overlap):
    tok = tokencount.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [made(k, 300) for k in range(3)] + ["x" * 3000, " " * 1000, "a  b \n\n c" * 200, "word  word　  é " * 80, "<|endoftext|> a" * 60, "日本語" * 300, "it's we'll " * 100]
    for t in texts:
        want = tok.encode(t, add_special_tokens=False).ids
        assert [i for part in tokencount.spliced_ids(tok, t, chunk, overlap) for i in part] == want


def test_token_counts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = tokencount.tokenizer(path)
    got = tokencount.token_counts(frame(spark, AWKWARD).withColumn("n_tokens", F.lit("x")), path, huge=1000, chunk=500).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((i or 0, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in AWKWARD)
    assert tokencount.token_counts(frame(spark, []), path).count() == 0
    model = tokencount.token_counts(frame(spark, AWKWARD[:5]), public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert len(model) == 5


def test_pipeline(spark):
    import corpus_pipeline

    docs, scratch = spark.read.parquet(f"{SF}/documents.parquet"), Scratch(spark, "t")
    columns, seen = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.save(stage(spark, docs, SF), name)
        if name != "packing":
            assert docs.columns == columns and 0 < docs.count() <= seen
            seen = docs.count()
    assert docs.select("doc_id").distinct().count() == seen
    empty = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
    odd = frame(spark, AWKWARD)
    assert {r.doc_id for r in corpus_pipeline.language(spark, odd, SF).collect()} <= {5, 6, 7}


def test_texts_that_stay_as_they_are_are_not_shuffled(spark):
    """Only rows that a stage may cut or drop go through the shuffle of its join; null ids and repeated ids stay."""
    import corpus_pipeline

    held = lambda: set(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n"))
    rng, auto, broad = np.random.default_rng(8), "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.autoBroadcastJoinThreshold"
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 100").orderBy("item_id").first()
    rows = [(i, rng.bytes(1500).hex()) for i in range(1000)] + [(7, "the same id again " * 3), (None, "no id " * 3), (1001, item.text)]
    docs = Scratch(spark, "t").save(frame(spark, rows), "docs")
    passages = Scratch(spark, "t").save(spark.createDataFrame([(7, 0, 4, 1), (9, 0, 1, 2)], "doc_id bigint, start int, end int, source_id bigint"), "passages")
    spark.conf.set(auto, "-1")
    spark.conf.set(broad, "-1")
    try:
        for out, want in (
            (lambda: substring.without_repeats(docs, passages), [(i, t) for i, t in rows if i not in (7, 9)] + [(7, "the same id again the same id again")]),
            (lambda: corpus_pipeline.decontaminated(spark, docs, SF), [r for r in rows if r[0] != 1001]),
        ):
            before = held()
            got = [(r.doc_id, r.text) for r in out().collect()]
            size = sum(os.path.getsize(f) for f in held() - before if f.endswith(".data") and os.path.exists(f))
            assert sorted((i or -1, t.strip()) for i, t in got) == sorted((i or -1, t.strip()) for i, t in want)
            assert size < 300_000  # of 3,000,000 characters, 1,500,000 bytes if they are compressed well
    finally:
        spark.conf.unset(auto)
        spark.conf.unset(broad)


def test_scratch_tables_of_joins_stay_small(spark, monkeypatch):
    """The windows of all texts go straight to their join, and sets are not kept twice while stars are compared."""
    seen, save = {}, Scratch.save

    def watched(self, df, name):
        out = save(self, df, name)
        seen[name] = {p.name[4:]: sum(f.stat().st_size for f in p.glob("*.parquet")) for p in pathlib.Path(self.base.removeprefix("file:")).iterdir()}
        return out

    monkeypatch.setattr(Scratch, "save", watched)
    rows = [(i, made(500 + i, 3000)) for i in range(20)]
    assert substring.repeated_passages(frame(spark, rows)).count() == 0
    assert max(sum(x.values()) for x in seen.values()) < 0.2 * sum(len(t) for _, t in rows)
    assert len({r.component_id for r in setjoin.jaccard_components(frame(spark, near_copies(3))).collect()}) > 1
    assert "grouped" in seen["met"] and "sets" not in seen["met"]
