"""The ten operators on small rows: brute force, round trips, and odd inputs (nulls, empty and long texts, ties,
repeated rows, empty tables, clashing column names)."""

import base64
import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from guardlake.llm import decontaminate, langid, line_dedup, media, near_dedup, packing, pii, quality, substring_dedup, warc
from guardlake.llm.common import new_folder, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{chr(97 + i % 26)}{i}" for i in range(400)]


def prose(seed, n=120):
    r = random.Random(seed)
    out = []
    while n > 0:
        k = min(n, r.randint(5, 12))
        out.append(" ".join(r.choice(WORDS) for _ in range(k)).capitalize() + ".")
        n -= k
    return " ".join(out)


def lines(seed, n=8):
    return "\n".join(prose(seed * 100 + i, 12) for i in range(n))


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)], SCHEMA)


ODD = [None, "", " ", "\n\n", "x", "word " * 30_000, "a\x00b", "é日本 🙂", "same text", "same text"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(ODD)] + [(8, "same text", None, None, None), (None, "no id", None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


# 1 line dedup


def brute_lines(texts, k=line_dedup.MIN_RUN):
    seen, out = set(), []
    for text in texts:
        if text is None:
            out.append(None)
            continue
        whole = text.split("\n")
        at = [i for i, x in enumerate(whole) if x.strip(" ")]
        seq = [whole[i].strip(" ") for i in at]
        gone = set()
        windows = [tuple(seq[i : i + k]) for i in range(len(seq) - k + 1)] if len(seq) >= k else [tuple(seq)] if seq else []
        for i, w in enumerate(windows):
            if w in seen:
                gone.update(at[i : i + len(w)])
            seen.add(w)
        out.append("\n".join(x for i, x in enumerate(whole) if i not in gone))
    return out


def test_line_dedup_equals_brute_force(spark):
    r = random.Random(4)
    pool = [f"line {i}" for i in range(6)] + [""]
    texts = ["\n".join(r.choice(pool) for _ in range(r.randint(0, 9))) for _ in range(60)] + [lines(1), "intro\n" + lines(1) + "\nend", lines(2), lines(2), None]
    got = {x.doc_id: x for x in line_dedup.dedup_lines(docs(spark, texts), long_words=None).collect()}
    assert [got[i].text for i in range(len(texts))] == brute_lines(texts)
    assert got[61].n_removed == 8 and got[62].n_removed == 0 and got[63].text == ""


def brute_long_runs(texts, k=line_dedup.MIN_RUN, words=line_dedup.LONG_WORDS):
    """brute_lines, and runs of fewer than k lines with that many words."""
    seen, out = set(), []
    for text in texts:
        whole = text.split("\n")
        at = [i for i, x in enumerate(whole) if x.strip(" ")]
        seq = [whole[i].strip(" ") for i in at]
        gone = set()
        for n in range(1, k + 1):
            for i in range(len(seq) - n + 1):
                run = tuple(seq[i : i + n])
                if n == k or n == len(seq) or sum(len(x.split()) for x in run) >= words:
                    kind = n == k or (n == len(seq) and "whole")
                    for key in {(run, kind), (run, False)} if sum(len(x.split()) for x in run) >= words and n < k else {(run, kind)}:
                        if key in seen:
                            gone.update(at[i : i + n])
                        seen.add(key)
        out.append("\n".join(x for i, x in enumerate(whole) if i not in gone))
    return out


def test_line_dedup_long_runs_equal_brute_force(spark):
    r = random.Random(5)
    pool = [prose(900 + i, n) for i, n in enumerate((5, 20, 24, 25, 26, 30, 49, 50, 51, 80))] + ["", "  "]
    texts = ["\n".join(r.choice(pool) for _ in range(r.randint(0, 5))) for _ in range(60)]
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(docs(spark, texts), long_words=line_dedup.LONG_WORDS).collect()}
    assert [got[i] for i in range(len(texts))] == brute_long_runs(texts) != brute_lines(texts)


def test_line_stage_cuts_long_passages_on_few_lines(spark):
    long, half, other = prose(801, 60), prose(802, 30), prose(803, 30)
    texts = [f"{long}\nsome end", f"a start\n{long}\nanother end", f"{half}\n{other}", f"before\n{half}\n{other}\nafter\nmore", f"x\n{half}\ny"]
    got = {x.doc_id: x for x in corpus_pipeline.line_stage(spark, docs(spark, texts), "").collect()}
    assert [got[i].text for i in range(5)] == [texts[0], "a start\nanother end", texts[2], "before\nafter\nmore", texts[4]]
    assert [got[i].n_chars for i in range(5)] == [len(got[i].text) for i in range(5)]


def test_line_dedup_is_linear_in_a_documents_lines(spark):
    lines = "\n".join(f"line number {i}" for i in range(30_000))
    began = time.perf_counter()
    got = line_dedup.dedup_lines(spark.createDataFrame([(1, lines), (2, lines + "\nlast")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [x.n_removed for x in got] == [0, 30_000] and got[1].text == "last" and time.perf_counter() - began < 90


@pytest.mark.parametrize("dedup", [line_dedup.dedup_lines, substring_dedup.dedup_spans])
def test_clashing_names(spark, dedup):
    names = ["_doc", "doc", "tag", "_tag", "d", "t", "_d", "_t", "runs", "cuts", "sources_", "f", "k", "line", "a.b"]
    text = prose(7, 80)
    rows = docs(spark, [text, "x " + text, None]).withColumns({n: F.lit("clash") for n in names})
    out = dedup(rows)
    assert set(rows.columns) <= set(out.columns) and len(out.collect()) == 3 and out.where("`a.b` = 'clash' and doc = 'clash'").count() == 3


def test_line_dedup_odd_rows(spark, odd):
    out = line_dedup.dedup_lines(odd.withColumn("n_lines", F.lit("clash")).withColumn("line", F.lit(1)).withColumn("a.b", F.lit(2))).collect()
    assert len(out) == 13 and all(x.text is None for x in out if x.doc_id == 0)
    assert {x.text for x in out if x.doc_id == 8} == {"same text"} and [x.text for x in out if x.doc_id == 9] == [""]
    assert line_dedup.dedup_lines(odd.limit(0)).collect() == []


def test_line_dedup_stays_in_the_jvm(spark):
    plan = line_dedup.dedup_lines(docs(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 2 packing


def test_packing(spark, odd):
    texts = [prose(i, random.Random(i).randint(1, 900)) for i in range(30)]
    for df, rows in ((docs(spark, texts), dict(enumerate(texts))), (odd, None)):
        pieces = packing.pack(df).collect()
        by_sequence, by_doc = collections.defaultdict(list), collections.defaultdict(list)
        for p in pieces:
            by_sequence[p.sequence_id].append(p)
            by_doc[p.doc_id].append(p)
            assert len(p.ids) == 4 * p.length > 0
        for ps in by_sequence.values():
            at = 0
            for p in sorted(ps, key=lambda p: p.offset):
                assert p.offset == at
                at += p.length
            assert at <= 2048
        if rows:
            whole = packing.Encoder(tokenizer_path("byte_bpe_50k.json")).tokenizer
            for d, ps in by_doc.items():
                ps.sort(key=lambda p: p.start)
                ids = np.frombuffer(b"".join(p.ids for p in ps), "<u4").tolist()
                assert ids == [*whole.encode(rows[d], add_special_tokens=False).ids, 1] and ps[0].doc_tokens == len(ids)
                assert [p.start for p in ps] == [sum(q.length for q in ps[:i]) for i in range(len(ps))]
        else:
            assert sum(p.length for p in by_doc[0]) == 1 and len(by_doc[8]) == 2
    assert packing.pack(odd.limit(0)).collect() == []
    crc = packing.piece_digests(packing.pack(docs(spark, ["hi there"]))).first()
    piece = packing.pack(docs(spark, ["hi there"])).first()
    assert crc.ids_crc32 == zlib.crc32(piece.ids)


@pytest.mark.parametrize("partitions", [4, 200])
def test_packing_leaves_one_short_sequence_however_many_partitions(spark, partitions):
    texts = [prose(i % 40, 60 + 7 * (i % 40)) for i in range(120)] + ["hot copy " * 50] * 60  # ties of the key, and a hot one
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        pieces = packing.pack(docs(spark, texts).withColumns({"key": F.lit(1), "range": F.lit("x"), "ids": F.lit(2)})).select("doc_id", "start", "length", "sequence_id", "offset").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    filled = collections.Counter()
    for p in pieces:
        filled[p.sequence_id] += p.length
    assert sorted(filled) == list(range(len(filled))) and [n for k, n in sorted(filled.items())][:-1] == [2048] * (len(filled) - 1)
    assert sum(filled.values()) == sum(p.length for p in pieces) and {p.doc_id for p in pieces} == set(range(len(texts)))


def test_cuts_split_hot_bins():
    cuts = packing.Cuts([(0, 1), (5, 3), (9, 1)])
    assert cuts.total == 6
    got = cuts.ranges(np.array([0, 4, 5, 5, 5, 6, 8, 9, 99]), np.array([7, 7, 0, 1, 2, 0, 1, 5, 5]))
    assert got.tolist() == [0, 0, 1, 2, 3, 4, 4, 5, 5]


def test_encoder_equals_library():
    e = packing.Encoder(tokenizer_path("byte_bpe_50k.json"))
    r = random.Random(1)
    parts = [" ", "\n", "a", "the", "'s", "12", ".", "é", "  ", " ", "!", "日本", "'", "<|endoftext|>", "\t", " the", "\r", "word,", "don't."]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(1500)]
    assert [e.encode(t).tolist() for t in texts] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    slow = packing.Encoder(e.path)
    slow.fast = None
    assert [slow.encode(t).tolist() for t in texts[:50]] == [e.encode(t).tolist() for t in texts[:50]]


def test_hilbert_neighbours_touch():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        axes = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = packing.hilbert_key(axes, bits)
        assert sorted(keys.tolist()) == list(range(len(axes)))
        path = axes[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


# 3 WARC


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "<p>x"), (2, None, None), (3, "http://b", "<p>x"), (4, "http://c x", ""), (5, "u", "é" * 50_000), (6, "v", "\r\n\r\nWARC/1.1\r\n"), (7, "w", "<p>x"), (7, "w", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit("clash"))
    got = collections.defaultdict(list)
    for x in warc.page_digests(pages).collect():
        got[x.page_id].append(x)
    first = {"<p>x": 1, "": 2}
    for page, _, html in rows[:6]:
        body, x = (html or "").encode(), got[page][0]
        refers = first.get(html or "", page)
        assert (x.payload_bytes, x.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (x.record_type, x.refers_to) == (("response", None) if refers == page else ("revisit", refers))
    assert sorted(x.record_type for x in got[7]) == ["response", "revisit"]
    assert warc.page_digests(pages.limit(0)).collect() == []


def test_warc_seeks_one_record(spark):
    pages = spark.createDataFrame([(i, "u", f"body {i} " * 100) for i in range(50)], "page_id long, url string, html string").coalesce(1)
    index = warc.write_bundles(pages, new_folder(spark, "seek"))
    raw = {x.page_id: bytes(x.record) for x in warc.fetch_records(index.where("page_id in (3, 49)")).collect()}
    assert set(raw) == {3, 49} and next(warc.parse_records(raw[49]))[2] == b"body 49 " * 100


def test_warc_keeps_payloads_of_one_page_apart(spark):
    rows = [(1, "u", "AAAA"), (1, "u", "B"), (2, "u", "AAAA"), (3, "u", "B"), (None, "u", "B"), (None, None, "B")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((x.page_id or 0, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in warc.page_digests(pages).collect())
    sha = {t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode() for t in ("AAAA", "B")}
    assert got == sorted([(1, 4, sha["AAAA"], "response", None), (1, 1, sha["B"], "response", None), (2, 4, sha["AAAA"], "revisit", 1), (3, 1, sha["B"], "revisit", 1), (0, 1, sha["B"], "response", None), (0, 1, sha["B"], "response", None)], key=repr) or got == sorted(
        [(1, 4, sha["AAAA"], "response", None), (1, 1, sha["B"], "response", None), (2, 4, sha["AAAA"], "revisit", 1), (3, 1, sha["B"], "revisit", 1), (0, 1, sha["B"], "response", None), (0, 1, sha["B"], "response", None)]
    )
    index = warc.write_bundles(pages, new_folder(spark, "ids"))
    assert index.select("record_id").distinct().count() == len(rows)


def test_warc_attempts_do_not_touch_each_other(spark):
    """Two attempts with unlike row orders: the index of either reads back whole; the other's bundles are swept."""
    import os

    folder = new_folder(spark, "attempts")
    pages = spark.createDataFrame([(i, "u", f"body {i}") for i in range(40)], "page_id long, url string, html string")
    keyed = warc.with_first_copy(pages).coalesce(1)
    first = warc.map_arrow(keyed.orderBy("page_id").coalesce(1), warc._writer(folder, "r"), warc.INDEX_SCHEMA).collect()
    second = warc.map_arrow(keyed.orderBy(F.desc("page_id")).coalesce(1), warc._writer(folder, "r"), warc.INDEX_SCHEMA).collect()
    for rows in (first, second):
        index = spark.createDataFrame(rows, warc.INDEX_SCHEMA)
        assert {(x.page_id, next(warc.parse_records(bytes(x.record)))[2]) for x in warc.fetch_records(index).collect()} == {(i, f"body {i}".encode()) for i in range(40)}
    warc.sweep(folder, spark.createDataFrame(second, warc.INDEX_SCHEMA))
    left = {f for f in os.listdir(folder.removeprefix("file:")) if f.startswith("bundle-")}
    assert left == {x.bundle.rpartition("/")[2] for x in second} != {x.bundle.rpartition("/")[2] for x in first}


def test_one_bundle_is_read_by_many_tasks(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "u", random.Random(i).randbytes(40_000).hex()) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    index = warc.write_bundles(pages, new_folder(spark, "tasks"))
    frames = index.select("bundle", "frame").distinct().count()
    read = warc.read_bundles(index)
    tasks = read.select(F.spark_partition_id().alias("p")).distinct().count()
    assert frames > 2 and tasks > 1 and read.count() == 60


def test_frames_are_independent(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 100)
    path = tmp_path / "b"
    w = warc.BundleWriter(path.open("wb"))
    places = [w.add(bytes([65 + i]) * 60) for i in range(5)]
    w.close()
    with path.open("rb") as f:
        table = warc.seek_table(f)
        assert len(table) == 5 and all(warc.read_frame(f, *table[p[0]])[p[2] : p[2] + p[3]] == bytes([65 + i]) * 60 for i, p in reversed(list(enumerate(places))))


# 4 PII


def brute_pii(text):
    out = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            odd, even = digits[::-2], digits[-2::-2]
            luhn = (sum(map(int, odd)) + sum(2 * int(d) - 9 * (int(d) > 4) for d in even)) % 10 == 0
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (12 <= len(digits) <= 19 and luhn) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_equal_brute_force():
    r = random.Random(9)
    for _ in range(8000):
        text = "".join(r.choice("a1.@+- ()2\n%é") for _ in range(r.randint(0, 60)))
        assert pii.base_spans(text) == brute_pii(text)
    assert pii.base_spans("9" * 100_000) == [] and pii.base_spans("a" * 200_000 + "@") == []


@pytest.mark.parametrize(
    ("text", "kind", "hidden"),
    [
        ("mail jоhn.dоe@exаmple.com now", "email", "jоhn.dоe@exаmple.com"),
        ("write john (at) example [dot] org today", "email", "john (at) example [dot] org"),
        ("john dot doe at example dot com", "email", "john dot doe at example dot com"),
        ("call plus four nine one seven two three four five six seven eight now", "phone", "plus four nine one seven two three four five six seven eight"),
        ("host one nine two dot one six eight dot one dot two up", "ip", "one nine two dot one six eight dot one dot two"),
        ("é １９２.168.1.1 é", "ip", "１９２.168.1.1"),
        ("schreib max at firma punkt de heute", "email", "max at firma punkt de"),
        ("x jo​hn@exam​ple.com", "email", "jo​hn@exam​ple.com"),
    ],
)
def test_disguises(text, kind, hidden):
    found = pii.added_spans(text, pii.base_spans(text))
    assert (kind, text.index(hidden), text.index(hidden) + len(hidden)) in found


def test_plain_prose_is_left_alone(spark, odd):
    for text in ("look at example.com and one two three dots", "un deux fois at the point of no return", "a...b … c"):
        assert pii.added_spans(text, pii.base_spans(text)) == []
    out = {x.doc_id: x for x in pii.span_digests(pii.find_pii(odd)).collect()}
    assert out[0].spans == "" and out[0].base_sha256 == hashlib.sha256(b"").hexdigest() and len(out) == 11
    row = pii.span_digests(pii.find_pii(docs(spark, ["a@b.co é 10.0.0.1 x (at) y (dot) org"]))).first()
    assert (row.n_email, row.n_ip, row.spans) == (1, 1, "email:0:6,ip:9:17,email:18:36")


# 5 quality


def test_quality_drops_toxic_and_keeps_clean(spark):
    texts, labels = [], []
    for i in range(900):
        text = prose(i, 80)
        toxic = i % 9 == 0
        if toxic:
            words = text.split()
            for k in range(3, len(words), 9):
                words[k] = random.Random(i + k).choice(["grobnak", "flimsod", "zargle"])
            text = " ".join(words)
        low = i % 10 == 5
        texts.append(" ".join(w.upper() + "!!" for w in text.split()) if low else text)
        labels.append((i, int(not low), int(toxic)))
    lab = spark.createDataFrame(labels[:600], "doc_id long, quality int, toxic int")
    kept = {x.doc_id for x in quality.resample(docs(spark, texts), lab).collect()}
    clean = {i for i, q, t in labels if q and not t}
    bad = {i for i, q, t in labels if t or not q}
    assert len(clean - kept) <= 0.01 * len(clean) and len(bad & kept) <= 0.02 * len(bad)
    stay = {x.doc_id for x in quality.keep_sample(docs(spark, texts), lab).collect()}
    assert stay == kept


def test_quality_equals_plain_python(spark):
    """Ratios, noise and draw against dictionaries."""
    r = random.Random(3)
    texts = [prose(i, 30) if i % 4 else " ".join(r.choice(["BUY", "now!!!", "$$$", "w1"]) for _ in range(30)) for i in range(120)] + [None, ""]
    labels = [(i, int(i % 4 != 0), int(i % 12 == 0)) for i in range(90)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    raw, every = collections.Counter(), collections.Counter()
    for i, t in enumerate(texts):
        raw.update(found := quality.ngram_buckets(t).tolist())
        if i < 90 and labels[i][1] and not labels[i][2]:
            every.update(found)
    share = sum(every.values()) / sum(raw.values())
    ratio = {b: math.log((every[b] + 1) / (n * share + 1)) if abs(every[b] - n * share) / math.sqrt(n * share + 0.5) >= quality.SHRINK else 0.0 for b, n in raw.items()}
    expected = [sum(ratio[b] for b in quality.ngram_buckets(t).tolist()) for t in texts]
    got = {x.doc_id: x for x in quality.resample(docs(spark, texts), lab, k=len(texts), margin=1e9).collect()}
    assert all(abs(got[i].log_ratio - e) < 1e-3 for i, e in enumerate(expected)) and any(expected)
    keys = {i: got[i].log_ratio + quality.gumbel(i, t) for i, t in enumerate(texts)}
    assert all(abs(got[i].sample_key - k) < 1e-9 for i, k in keys.items())
    best = sorted(keys, key=keys.get, reverse=True)[:50]
    assert {x.doc_id for x in quality.resample(docs(spark, texts), lab, k=50, margin=1e9).collect()} == set(best)


def test_quality_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    nulls = spark.createDataFrame([(None, 1, 0), (1, None, 0), (5, 1, None), (8, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")
    for lab in (none, nulls):
        assert quality.resample(odd, lab).count() == 13
    assert quality.resample(odd.limit(0), nulls).count() == 0


def test_kth_largest(spark):
    r = random.Random(2)
    values = [r.gauss(0, 1) for _ in range(9000)] + [1.0] * 500 + [-1e9]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    order = sorted(values, reverse=True)
    for k in (1, 17, 4000, 8999, len(values) - 1):
        assert quality.kth_largest(df, "v", k) == order[k - 1]


# 6 substring dedup


def test_repeated_passages_go(spark):
    passage = prose(77, 60)
    texts = [prose(1) + " " + passage + " " + prose(2), prose(3) + "\n" + passage + "\n" + prose(4), prose(5), passage, passage + " " + prose(6) + " " + passage]
    got = {x.doc_id: x for x in substring_dedup.dedup_spans(docs(spark, texts)).collect()}
    assert got[0].text == texts[0] and got[2].text == texts[2]
    assert passage not in got[1].text and prose(3) in got[1].text and prose(4) in got[1].text and got[1].sources == [0]
    assert got[3].text == "" and got[4].text.strip() == prose(6)


def test_spans_cover_and_are_minimal():
    r = random.Random(3)
    for _ in range(300):
        counts = [r.randint(1, 20) for _ in range(r.randint(0, 15))]
        found = substring_dedup.spans(counts)
        expected = set()
        for i in range(len(counts)):
            for j in range(i + 2, len(counts) + 1):
                if sum(counts[i:j]) >= 30 and (j - i == 2 or sum(counts[i : j - 1]) < 30):
                    expected.add((i, j))
                    break
        for j in range(len(counts) + 1):
            for i in range(j - 2, -1, -1):
                if sum(counts[i:j]) >= 30:
                    expected.add((i, j))
                    break
        assert set(found) == expected
        if sum(counts) >= 30 and len(counts) >= 2:
            assert {k for i, j in found for k in range(i, j)} == set(range(len(counts)))


def test_substring_dedup_equals_brute_force(spark):
    r = random.Random(21)
    pool = [prose(600 + i, n).replace(". ", " ") for i, n in enumerate((3, 6, 9, 12, 14, 16, 18, 30, 55, 60))]
    texts = [" ".join(r.choice(pool) for _ in range(r.randint(0, 7))) for _ in range(50)]
    seen, expected = set(), []
    for text in texts:
        where = substring_dedup.sentences(text)
        words = [text[a:b].lower().split() for a, b in where]
        gone = set()
        for i, j in substring_dedup.spans([len(w) for w in words]):
            key = tuple(map(tuple, words[i:j]))
            if key in seen:
                gone.update(range(i, j))
            seen.add(key)
        expected.append("".join(text[a : where[k + 1][0] if k + 1 < len(where) else len(text)] for k, (a, _) in enumerate(where) if k not in gone))
    got = {x.doc_id: x.text for x in substring_dedup.dedup_spans(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == expected != texts


def test_substring_dedup_odd_rows(spark, odd):
    out = substring_dedup.dedup_spans(odd.withColumn("k1", F.lit(1)).withColumn("sources", F.lit("clash")))
    rows = out.collect()
    assert len(rows) == 13 and [x.text for x in rows if x.doc_id == 3] == ["\n\n"] and substring_dedup.dedup_spans(odd.limit(0)).count() == 0


# 7 near dedup


def brute_components(texts, k, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]))
    comp = list(range(len(sets)))
    changed = True
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            low = min(comp[i], comp[j])
            changed |= comp[i] != low or comp[j] != low
            comp[i] = comp[j] = low
    return [(len(s), c) for s, c in zip(sets, comp, strict=True)]


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_dedup_equals_brute_force(spark, k, percent):
    r = random.Random(8)
    base = prose(1, 150).split()
    texts = []
    for i in range(110):
        words = list(base)
        for _ in range(r.randint(0, 9)):
            words[r.randrange(len(words))] = f"edit{r.randrange(10_000)}"
        texts.append(" ".join(words))
    texts += [prose(i, 60) for i in range(2, 30)] + [prose(2, 60).upper(), "a b", "A  b", "a", None, "", "\x0b"]
    got = {x.doc_id: x for x in near_dedup.near_duplicates(docs(spark, texts), k, percent).collect()}
    expected = brute_components(texts, k, percent)
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == expected
    assert all(x.kept == (x.doc_id == x.component_id) for x in got.values())


def test_near_dedup_odd_rows(spark, odd):
    got = near_dedup.near_duplicates(odd.withColumn("rep", F.lit(1)).withColumn("band", F.lit(1))).collect()
    assert len(got) == 13 and {x.component_id for x in got if x.doc_id in (8, 9)} == {8} and {x.n_shingles for x in got if x.doc_id == 0} == {0}
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns and 9 not in [x.doc_id for x in kept.collect()]
    assert near_dedup.near_duplicates(odd.limit(0)).count() == 0


def test_near_dedup_without_ids(spark):
    """Null and repeated doc_ids are nodes like any other; one row of a component stays."""
    base, other = prose(31, 120).split(), prose(32, 90)
    near = [" ".join([*base[:i], "edit", *base[i + 1 :]]) for i in (10, 60)]
    rows = [(None, " ".join(base)), (None, near[0]), (5, near[1]), (9, other), (9, prose(33, 90)), (9, other + " end"), (None, prose(34, 90)), (None, prose(34, 90)), (3, "solo"), (3, "solo"), (None, None), (1, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("rep", "gone_", "doc", "tag", "d", "t", "stays")})
    got = sorted((x.doc_id or -1, x.component_id or -1, x.kept) for x in near_dedup.near_duplicates(df).collect())
    assert got == sorted([(-1, 5, False), (-1, 5, False), (5, 5, True), (9, 9, True), (9, 9, True), (9, 9, True), (-1, -1, True), (-1, -1, True), (3, 3, True), (3, 3, True), (-1, -1, True), (1, 1, True)])
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns
    texts = sorted(x.text or "" for x in kept.collect())
    assert len(texts) == 7 and texts.count("solo") == 1 and texts.count(near[1]) == 1 and sum(t in (other, other + " end") for t in texts) == 1


def test_thresholds_fall_with_evidence():
    most = near_dedup.most_different(85)
    assert list(most) == sorted(most) and all(m < 32 * (i + 1) for i, m in enumerate(most))
    for percent in (80, 85):
        bands, rows = near_dedup.banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands < 1e-6


# 8 language


def test_language(spark, odd):
    alphabets = {"aa": "bcdfg", "bb": "lmnpr", "cc": "stvwz"}
    r = random.Random(5)

    def text(lang):
        return " ".join("".join(r.choice(alphabets[lang]) + r.choice("aeiou") for _ in range(3)) for _ in range(30))

    rows = [(i, text(lang := ("aa", "bb", "cc")[i % 3]), lang, "s", 0) for i in range(300)]
    got = {x.doc_id: x for x in langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in held) for i in got)
    assert sum(got[i].lang_pred == rows[i][2] for i in held) >= 0.99 * len(held) and all(0 <= x.score <= 1 for x in got.values())
    strange = langid.identify(odd).collect()
    assert len(strange) == 13 and {x.lang_pred for x in strange} == {"und"}
    model = langid.fit(spark.createDataFrame(rows, SCHEMA))
    assert model.predict("12 34 !!")[0] == "und" and model.predict(None)[0] == "und" and model.predict("qxqx jkjk yyyy hhhh")[2]


def test_language_sample_is_bounded_and_skips_none(spark):
    r = random.Random(2)
    rows = [("aa", "the same text")] * 3000 + [("aa", f"text {i}") for i in range(30)] + [("bb", f"only {i}") for i in range(3)] + [(f"l{i:04d}", f"words of {i}") for i in range(1200)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "lang string, text string")
    hashes = collections.defaultdict(set)
    for x in df.select("lang", F.xxhash64("text").alias("h")).distinct().collect():
        hashes[x.lang].add(x.h)
    for most, every in ((10, 20_000), (400, 2404)):
        each = max(1, min(most, every // len(hashes)))
        got = collections.defaultdict(list)
        for x in langid.sample(df, most, every).collect():
            got[x.lang].append(x.hash)
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:each] for k, v in hashes.items()}
    assert langid.sample(df.limit(0)).count() == 0


def test_nearest_centroid_equals_brute_force(spark):
    r = random.Random(4)
    rows = [(i, " ".join("".join(r.choice("bcdfg" if i % 2 else "lmnpr") + r.choice("aeiou") for _ in range(3)) for _ in range(20)), "xy"[i % 2], "s", 0) for i in range(80)]
    model = langid.fit(spark.createDataFrame(rows, SCHEMA))
    got = {x.doc_id: x for x in langid.predict(spark.createDataFrame(rows, SCHEMA), model).collect()}
    for i, text, *_ in rows[:20]:
        v = [math.log1p(0)] * 0 or [float(c) * float(w) for c, w in zip(langid.gram_counts(langid.letters(text)), model.idf, strict=True)]
        norm = math.sqrt(sum(x * x for x in v))
        cosines = [sum(float(a) * b for a, b in zip(c, v, strict=True)) / norm for c in model.centroids]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert got[i].lang_pred == model.languages[model.owner[best]] and abs(got[i].score - cosines[best]) < 1e-4


# 9 decontamination


def test_edited_copies_are_found(spark):
    """Copies with one word in 40 changed, put in or taken out, or cut at an end, wherever the exact similarity is 0.8."""
    r = random.Random(12)
    every = [(i, prose(3000 + i, n)) for i, n in enumerate([*range(5, 60), 80, 120, 200, 400] * 2)]
    items = decontaminate.Items(every)
    found = total = 0
    for i, text in every:
        for kind in ("sub", "ins", "del", "front", "back"):
            w = text.split()
            for _ in range(max(1, len(w) // 40) if kind in ("sub", "ins", "del") else 0):
                p = r.randrange(len(w))
                w[p : p + (kind != "ins")] = [] if kind == "del" else ["changed"]
            cut = r.randint(1, max(1, len(w) // 6))
            w = w[cut:] if kind == "front" else w[:-cut] if kind == "back" else w
            doc = " ".join([prose(i, r.randint(1, 30)), *w, prose(i + 500, r.randint(1, 30))])
            h = decontaminate.word_hashes(decontaminate.loose_words(doc))
            n = len(items.rows[i][1])
            if max(items.similarity(i, h[a : a + n]) for a in range(max(1, len(h) - n + 1))) >= 0.8:
                total += 1
                found += i in decontaminate.document_hits(items, [doc], 0.8)[0]
    assert total > 200 and found >= 0.995 * total


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    shared = prose(70, 20)
    items = [(i, shared + " " + prose(4000 + i, 30)) for i in range(12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [shared + " " + prose(5000 + i, 30) for i in range(5)] + ["x " + items[3][1], prose(71, 10) + items[7][1]]

    def hits():
        return sorted((x.doc_id, x.item_id, round(x.similarity, 9)) for x in decontaminate.find_leaks(docs(spark, texts), bench).collect())

    whole = hits()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 700)
    assert hits() == whole and {x[:2] for x in whole} == {(5, 3), (6, 7)}


def test_leaks_are_found_wherever_they_start(spark):
    r = random.Random(6)
    items = [prose(1000 + i, n) for i, n in enumerate((3, 7, 14, 15, 22, 31, 38, 57, 120, 300))]
    bench = spark.createDataFrame([*enumerate(items), (98, None), (99, "...")], "item_id long, text string")
    texts, truth = [], []
    for i, item in enumerate(items):
        for before in (0, 1, 5, 8, 13):
            texts.append((prose(i * 50 + before, before) + " " if before else "") + item.upper().replace(".", " ;") + " " + prose(i, r.randint(0, 30)))
            truth.append({i})
    texts += [prose(5000 + i, 200) for i in range(20)]
    truth += [set()] * 20
    hits = collections.defaultdict(set)
    for x in decontaminate.find_leaks(docs(spark, texts), bench).collect():
        hits[x.doc_id].add(x.item_id)
        assert x.similarity >= 0.8
    assert [hits[i] for i in range(len(texts))] == truth
    left = decontaminate.drop_leaks(docs(spark, texts), bench)
    assert sorted(x.doc_id for x in left.collect()) == list(range(len(items) * 5, len(texts))) and left.columns == docs(spark, []).columns


def test_index_finds_all_within_radius():
    rng = np.random.default_rng(1)
    items = decontaminate.Items([(i, prose(i, 31)) for i in range(20)])
    plan, (values, _, _, _) = next(iter(items.plans.items()))
    prints = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    for k in range(0, 3000, 3):  # near ones, at up to 9 flipped bits
        flips = sum(1 << int(b) for b in rng.choice(64, k % 10, replace=False))
        prints[k] = values[k % len(values)] ^ np.uint64(flips)
    w, _, _ = items.candidates(plan, prints)
    brute = np.bitwise_count(prints[:, None] ^ values[None, :]) <= decontaminate.RADIUS
    assert len(w) == brute.sum() and set(w.tolist()) == set(np.flatnonzero(brute.any(axis=1)).tolist())


def test_leaks_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, "no id"), (2, "")], "item_id long, text string")
    hits = decontaminate.find_leaks(odd.withColumn("item_id", F.lit(5)), bench).collect()
    assert sorted((x.doc_id, x.item_id) for x in hits if x.doc_id is not None) == [(8, 1), (8, 1), (9, 1)]
    assert decontaminate.find_leaks(odd, bench.limit(0)).count() == 0 and decontaminate.find_leaks(odd.limit(0), bench).count() == 0


# 10 media


def test_media_round_trip(spark, odd):
    got = collections.defaultdict(list)
    for x in media.digests(media.parse_audio(media.encode_texts(odd.withColumn("media", F.lit(1))))).collect():
        got[x.doc_id].append(x)
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        x = got[i][0]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert x.media_sha256 == hashlib.sha256(media.write_audio(payload, len(raw))).hexdigest()
    assert got[8][0].feature == got[9][0].feature and len(got[8]) == 2
    assert media.parse_audio(media.encode_texts(odd.limit(0))).count() == 0
    assert media.parse_audio(spark.createDataFrame([(1, None), (2, bytearray(b"nothing"))], "doc_id long, media binary")).orderBy("doc_id").collect()[1].frames == 0


def test_media_round_trip_of_letters_of_several_bytes_and_tag_like_texts(spark):
    texts = ["é" * 100, "x" * 70 + "日本 🙂" * 20, "é" * 32, "ÿ" * 1000, *["a" * n + "TAG and more of it" for n in range(700, 1000, 3)], "TAG" * 300, "TAG" * 313]
    for x in media.digests(media.parse_audio(media.encode_texts(docs(spark, texts)))).collect():
        raw = texts[x.doc_id].encode()
        payload = raw + bytes(-len(raw) % 64)
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_tag_like_bytes_of_a_frame_are_no_tag():
    for n in range(700, 1000):
        payload = (b"a" * n + b"TAG").ljust(1024, b"b")
        whole = media.write_audio(payload, len(payload))
        a = media.read_audio(whole)
        assert a.main[:1024] == payload and a.resyncs == 0 and "TIT2" not in a.tags
        b = media.read_audio(whole + b"TAG" + b"My title".ljust(125, b"\0"))
        assert b.tags["TIT2"] == "My title" and b.main == a.main
    cut = media.read_audio(whole[:-30] + b"TAG" + b"My title".ljust(125, b"\0"))
    assert cut.tags["TIT2"] == "My title" and cut.resyncs == 1 and len(cut.offsets) == len(a.offsets) - 1
    assert media.read_audio(b"TAG" + b"Alone".ljust(125, b"\0")).tags == {"TIT2": "Alone"}


def test_resync_crc_and_durations():
    payload = bytes(range(1, 250)) * 20
    whole = media.write_audio(payload, len(payload))
    a = media.read_audio(whole)
    assert a.main[: len(payload)] == payload and a.resyncs == 0 and a.bad_crc == 0 and a.samples == 1152 * len(a.offsets) and a.vbr["frames"] == len(a.offsets)
    assert abs(a.seconds - a.samples / 48000) < 1e-9
    junk = whole[: a.offsets[2]] + b"junk \xff\xfb junk" + whole[a.offsets[2] :]
    b = media.read_audio(junk)
    assert b.resyncs == 1 and len(b.offsets) == len(a.offsets) and b.main == a.main
    hurt = bytearray(whole)
    hurt[a.offsets[1] + 8] ^= 1
    assert media.read_audio(bytes(hurt)).bad_crc == 1
    assert media.parse_header(b"\xff\xfb\x90\x00").length == 417 and media.parse_header(b"\xff\xfd\x80\x00").layer == 2 and media.parse_header(b"\xff\xff\x90\x00").layer == 1
    one = bytes((0xFF, 0xFE, 0x90, 0xC0))  # layer I, protected, mono: the checksum covers 16 bytes of allocation
    h = media.parse_header(one)
    body = bytes(i % 251 for i in range(h.length - 6))
    good = one + media.crc16(one[2:4] + body[:16]).to_bytes(2, "big") + body
    assert (h.layer, h.protected, h.covered) == (1, True, 16) and media.read_audio(good * 3).bad_crc == 0 and media.read_audio(good * 2 + one + b"\0\0" + body).bad_crc == 1
    assert media.parse_header(bytes((0xFF, 0xFE, 0x90, 0x50))).covered == 20
    two = bytes((0xFF, 0xFC, 0x90, 0xC0))
    assert media.read_audio((two + bytes(media.parse_header(two).length - 4)) * 2).unchecked_crc == 2
    tagged = whole + b"TAG" + b"My title".ljust(125, b"\0")
    assert media.read_audio(tagged).tags["TIT2"] == "My title" and media.read_audio(tagged).main == a.main
