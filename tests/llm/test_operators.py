"""The operators against brute force on small inputs, with nulls, empties, ties and clashing names."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from berrak.llm import bag_minhash, chat_format, compression_bands, decontaminate, importance_resampling, run_length_index, sharding, soft_mixing, toxicity_mil, warc_derive
from berrak.llm.components import components
from berrak.llm.queries import QUERIES


def words(n, seed=0):
    r = random.Random(seed)
    return " ".join(r.choice("abcdefgh") + r.choice("klmnop") + str(r.randrange(60)) for _ in range(n))


DOCS = [
    (1, words(200, 1)), (2, words(200, 1)), (3, words(198, 1) + " x y"), (4, None), (5, ""), (6, " \n\t "), (7, "tek"), (8, ""),
    (9, "la " * 3000), (10, words(20000, 3)), (None, words(50, 4)), (11, words(60, 5) + "\n" + words(60, 5)), (12, words(100, 6)), (12, words(100, 6)),
]


@pytest.fixture
def docs(spark):
    rows = [(i, t, "en", True, 1.0, 7) for i, t in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, kept boolean, score double, shard int")


@pytest.fixture
def empty(docs):
    return docs.where("false")


# quality rules


def brute_quality(text):
    ws = [w for w in (text or "").encode().replace(b"\n", b" ").split()]
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    grams = Counter(tuple(ws[k : k + 8]) for k in range(len(ws) - 7))
    hit = {j for k in range(len(ws) - 7) if grams[tuple(ws[k : k + 8])] > 1 for j in range(k, k + 8)}
    return len(ws), sum(len(w.decode()) for w in ws), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_compression_counts(docs):
    got = compression_bands.compression_bands(docs).collect()
    assert len(got) == len(DOCS)
    for r in got:
        n = brute_quality(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        assert not (r.base_failed and r.kept)


def test_compression_verdicts(spark):
    r = random.Random(2)
    noise = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(6000))
    loop = " ".join(f"w{k % 3} z{k // 400}" for k in range(3000))
    rows = [(1, " ".join(noise[k : k + 76] for k in range(0, 6000, 76))), (2, loop), (3, "One day " + words(400, 9))]
    got = {x.doc_id: x.kept for x in compression_bands.compression_bands(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: False, 2: False, 3: True}


def test_quality_stage_keeps_columns(docs, empty):
    assert compression_bands.quality_stage(docs).columns == docs.columns
    assert compression_bands.quality_stage(empty).count() == 0


def test_compression_bands_reject_few_words_and_symbols(spark, sf_dir):
    """Labelled bad rows that the base rules let pass fall to the bands; good ones stay."""
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = compression_bands.compression_bands(docs, keep=["doc_id"]).join(labels, "doc_id").where("not base_failed")
    by = {x.quality: (x.n, x.kept) for x in got.groupBy("quality").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept")).collect()}
    assert by[0][1] < 0.5 * by[0][0] and by[1][1] >= 0.99 * by[1][0]


def test_compression_judges_the_last_chunk(spark):
    text = words(1700, 21).encode()[:8000]
    half = text[:4096].decode() + " ".join("|" * 3 for _ in range(2000))[: 4096 + 1023]
    assert [len(x) for x in compression_bands._pieces(text[:7167], 2048)] == [2048, 2048, 3071]
    assert [len(x) for x in compression_bands._pieces(text[:7168], 2048)] == [2048, 2048, 2048, 1024]
    assert compression_bands._pieces(b"", 2048) == [b""]
    got = compression_bands.compression_bands(spark.createDataFrame([(1, half)], "doc_id long, text string")).first()
    assert (got.n_chunks, got.n_bad_chunks) == (4, 2)


def test_compression_fit(spark):
    r = np.random.default_rng(1)
    sizes = 2 ** r.uniform(8, 14, 2000)
    ratios = 0.9 - 0.03 * np.log2(sizes) + r.normal(0, 0.005, 2000)
    low, high = compression_bands.Bands(whole=compression_bands.fit(sizes, ratios)).limits(sizes)
    assert np.mean((ratios < low) | (ratios > high)) < 0.005 and np.mean(ratios - 0.03 < low) > 0.8
    docs = spark.createDataFrame([(k, words(40 + 3 * k, k)) for k in range(100)], "doc_id long, text string")
    fitted = compression_bands.fit_bands(docs, docs.select("doc_id", F.lit(1).alias("quality")))
    assert compression_bands.compression_bands(docs, bands=fitted).where("kept").count() >= 98


# chat formatting


CHATS = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (2, 0, "system", "\\[INST]\\</s>\\\\"), (2, 1, "user", "<</s>é😀"), (2, 2, "assistant", "a\\"), (3, 0, "tool[/ROLE]", "x\ny"), (3, 1, None, None), (3, 2, "assistant", ""), (3, 3, "assistant", "zz[OUT]</s>\\"), (3, 3, "assistant", "tie"), (None, 0, "user", "lost"), (4, None, "assistant", "only"), (5, 0, "assistant", None), (5, 1, "user", "\\" * 5 + "[")]


def test_chats_round_trip(spark):
    rows = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string")
    made = chat_format.format_chats(chat_format.records_of_turns(rows))
    got = made.select("conv_id", "layout", chat_format.read_back(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    want = defaultdict(list)
    for c, t, r, x in sorted(CHATS, key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        want[c].append((r or "", x or ""))
    assert {r.conv_id: [(t.role, t.text) for t in r.turns] for r in got} == dict(want)
    assert {r.conv_id: r.loss for r in got} == {c: "".join(x for r, x in turns if r == "assistant") for c, turns in want.items()}
    assert {r.conv_id: r.layout for r in got} == {1: "prompt", 2: "instruction", 3: "messages", 4: "messages", 5: "messages", None: "messages"}


def test_fingerprints_select_layouts(spark):
    rows = [('{"prompt": "p"}',), ('{"prompt": "p", "response": "r"}',), ('{"instruction": "i", "output": "o"}',), ('{"messages": [{"role": "user", "content": "m"}]}',), ('{"messages": []}',), ('{"output": "o"}',), (None,)]
    parsed = spark.createDataFrame(rows, "raw string").withColumn("record", F.from_json("raw", chat_format.RECORD)).withColumn("turns", F.lit("clash"))
    got = chat_format.format_chats(parsed).select("layout", "formatted").collect()
    assert [r.layout for r in got] == ["prompt", "prompt", "instruction", "messages", None, None, None]
    assert got[1].formatted == "<s>[INST]p[/INST][OUT]r</s>" and got[4].formatted == "<s>"


LAYOUTS = [
    ('{"prompt": "p", "completion": "c"}', "completion", [("user", "p"), ("assistant", "c")]),
    ('{"prompt": "p", "completion": "c", "response": "r"}', None, []),
    ('{"exchange": {"question": "q"}}', "exchange", [("user", "q")]),
    ('{"exchange": {"question": "q", "answer": "a", "context": ""}}', "exchange", [("system", ""), ("user", "q"), ("assistant", "a")]),
    ('{"exchange": {}}', None, []),
    ('{"conversations": [{"from": "Human", "value": "h"}, {"from": "gpt", "value": "g"}, {"value": "x"}, null, {"from": "tool"}]}', "shared", [("user", "h"), ("assistant", "g"), ("", "x"), ("", ""), ("tool", "")]),
    ('{"thread": {"messages": [{"author": {"role": "human"}, "body": "b"}, {"author": null, "body": "c"}]}}', "thread", [("human", "b"), ("", "c")]),
    ('{"thread": {"messages": [{"author": {"role": "user"}}]}}', None, []),
]


def test_nested_layouts_and_role_names(spark):
    parsed = spark.createDataFrame([(k, x[0]) for k, x in enumerate(LAYOUTS)], "k long, raw string").withColumn("record", F.from_json("raw", chat_format.RECORD))
    got = chat_format.canonical_turns(parsed).orderBy("k").collect()
    assert [(r.layout, [tuple(t) for t in r.turns]) for r in got] == [x[1:] for x in LAYOUTS]


def test_layouts_of_other_types(spark):
    """A list where a text is expected fits no mapping; numbers are texts; a type without roles has none."""
    rows = spark.sql("select struct(array('a') as prompt, cast(null as array<struct<content: int>>) as messages) as record union all select struct(cast(null as array<string>), array(struct(7 as content)))")
    got = {r.layout: [tuple(t) for t in r.turns] for r in chat_format.canonical_turns(rows).collect()}
    assert got == {None: [], "messages": [("", "7")]}


def test_very_long_chats(spark):
    text = "</s>[INST] \\" * 100_000
    rows = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    made = chat_format.format_chats(chat_format.records_of_turns(rows))
    got = made.select(chat_format.read_back(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert [t.text for t in got.turns] == [text, text] and got.loss == text


def test_chats_of_no_rows(spark):
    rows = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.format_chats(chat_format.records_of_turns(rows)).count() == 0


# decontamination


def brute_hits(text, items, window=10):
    ws = decontaminate._normal_words(text)
    hit, found = set(), set()
    for item, t in items:
        iw = decontaminate._normal_words(t)
        n = min(window, len(iw))
        for k in range(len(iw) - n + 1) if n else ():
            for j in range(len(ws) - n + 1):
                if ws[j : j + n] == iw[k : k + n]:
                    hit.update(range(j, j + n))
                    found.add(item)
    return len(ws), len(hit), sorted(map(str, found))


@pytest.mark.parametrize("block", [100_000, 30])
def test_decontamination_equals_brute_force(spark, block):
    r = random.Random(5)
    letters = lambda n: " ".join(r.choice("ab") for _ in range(n))
    items = [(k, letters(r.randint(0, 25))) for k in range(12)] + [(12, None), (13, "É b ÉB"), (3, letters(12))]
    texts = [(k, letters(r.randint(0, 60))) for k in range(40)] + [(40, None), (41, ""), (42, "x É-B! É b éb É b ÉB"), (43, " ".join(f"u{k}" for k in range(30)))]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("n_hit", F.lit("clash"))
    got = decontaminate.scan(docs, spark.createDataFrame(items, "item_id long, text string"), limits=decontaminate.Limits(block_words=block)).collect()
    for x in got:
        n, hit, ids = brute_hits(x.text, items)
        assert (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) == (n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0)


@pytest.mark.parametrize("blocks", [1, 3])
def test_decontamination_in_passes(spark, blocks):
    """Ids that are no numbers, items without an id, and repeated documents, over several passes."""
    r = random.Random(9)
    letters = lambda n: " ".join(r.choice("abc") for _ in range(n))
    items = [(f"set/{k}" if k % 4 else None, letters(r.randint(1, 20))) for k in range(20)] + [("set/1", ""), ("x,y", "a b")]
    texts = [(k % 17, letters(r.randint(0, 40))) for k in range(30)]
    docs = spark.createDataFrame(texts + texts[:3], "doc_id long, text string").withColumns({"runs": F.lit(1), "items": F.lit(2), "doc": F.lit(3), "cut": F.lit(4)})
    limits = decontaminate.Limits(block_words=20, blocks_per_pass=blocks)
    got = decontaminate.scan(docs, spark.createDataFrame(items, "item_id string, text string"), limits=limits).collect()
    assert len(got) == 33 and got[0].runs == 1 and got[0]["cut"] == 4
    for x in got:
        n, hit, ids = brute_hits(x.text, items)
        ids = sorted(i for i in ids if i != "None")
        assert (x.n_words, x.n_hit, x.n_items, x.items_sha256) == (n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest())


def test_decontamination_cuts_spans(spark):
    item = words(12, 7)
    docs = spark.createDataFrame([(1, f"{words(40, 8)} [{item}] end", 3, 5), (2, item, 3, 5), (3, None, 3, 5), (4, words(30, 9), 3, 5)], "doc_id long, text string, doc int, n_chars int")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate_stage(docs, bench).collect()}
    assert set(got) == {1, 3, 4} and got[1].text == f"{words(40, 8)} [] end" and got[1].n_chars == len(got[1].text)
    assert decontaminate.decontaminate_stage(docs, bench.where("false")).count() == 4


# near-duplicates


def multiset(text):
    ws = (text or "").encode().split()
    return Counter(tuple(ws[k : k + 5]) for k in range(len(ws) - 4)) if len(ws) >= 5 else Counter([tuple(ws)]) if ws else Counter()


def brute_classes(rows, similarity=0.8):
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, t, multiset(t)) for i, t in rows if i is not None and t is not None]
    for k, (i, t, a) in enumerate(sets):
        for j, u, b in sets[:k]:
            if t == u or (a and (a & b).total() >= similarity * (a | b).total()):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def near_copies():
    r, rows = random.Random(11), []
    for base in range(4):
        source = words(120, 100 + base).split()
        for _ in range(30):
            w = list(source)
            for _ in range(r.randint(0, 6)):
                w[r.randrange(len(w))] = f"n{r.randrange(999)}"
            rows.append(" ".join(w))
    rows += [words(120, 900 + k) + " " + words(30, 77) for k in range(20)] + ["", "", None, "a b", "a b", "a  b", "la " * 500, "la " * 480]
    return list(enumerate(rows))


@pytest.mark.parametrize("small", [6, 2])
def test_classes_equal_brute_force(spark, small):
    rows = near_copies()
    got = bag_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string"), bag_minhash.Settings(small_bucket=small)).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(rows)
    assert sum(r.kept for r in got) == len({r.class_id for r in got})


def test_signatures_are_unbiased():
    a = np.concatenate([np.arange(100), np.arange(1000, 1040)]).astype(np.uint64)
    b = np.concatenate([np.arange(100), np.arange(2000, 2030)]).astype(np.uint64)
    wa, wb = np.where(np.arange(140) < 50, 7, 1), np.where(np.arange(130) < 50, 4, 1)
    owner = np.concatenate([np.zeros(140, np.int64), np.ones(130, np.int64)])
    times = bag_minhash.signatures(owner, bag_minhash.mix(np.concatenate([a, b])), np.concatenate([wa, wb]), 2, 4096)
    want = (50 * 4 + 50) / (50 * 7 + 50 + 40 + 30)
    assert abs((times[0] == times[1]).mean() - want) < 4 * (want * (1 - want) / 4096) ** 0.5


def test_dedup_stage(docs, empty):
    kept = bag_minhash.dedup_stage(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 4, 5, 6, 7, 9, 10, 11, 12]
    assert bag_minhash.dedup_stage(empty).count() == 0


def test_components(spark):
    r = random.Random(3)
    edges = [(k, k + 1) for k in range(50)] + [(200 + r.randrange(30), 200 + r.randrange(30)) for _ in range(40)] + [(300, 301), (301, 300), (400, 400)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {x.id: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: find(k) for k in list(parent)}


# repeated text


def brute_removed(rows, size=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        mark = bytearray(len(raw))
        for p in range(len(raw) - size + 1):
            one = raw[p : p + size]
            if one in seen:
                mark[p : p + size] = b"\1" * size
            seen.add(one)
        runs = sum(mark[k] and (k == 0 or not mark[k - 1]) for k in range(len(mark)))
        out[i] = (len(raw), sum(mark), runs, hashlib.sha256(bytes(x for x, y in zip(raw, mark, strict=True) if not y)).hexdigest())
    return out


@pytest.mark.parametrize("settings", [run_length_index.Settings(), run_length_index.Settings(hot=15), run_length_index.Settings(index_bytes=2_000)])
def test_removed_bytes_equal_brute_force(spark, settings):
    r = random.Random(1)
    base = ["".join(r.choice("abcd é") for _ in range(400)) for _ in range(5)]
    rows = []
    for k in range(80):
        parts = [b[(a := r.randint(0, 300)) : a + r.randint(1, 250)] for b in r.choices(base, k=r.randint(0, 6))]
        rows.append((k, None if k == 7 else "ab" * r.randint(0, 200) if k % 9 == 0 else rows[r.randrange(k)][1] if k % 11 == 10 else "".join(parts)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tie", F.lit("clash")).repartition(3)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in run_length_index.remove_repeats(docs, s=settings).collect()}
    assert got == brute_removed(rows)
    assert run_length_index.remove_repeats(docs.where("false")).count() == 0


def test_matching_statistics_equal_brute_force():
    """An index with places at run ends only, against the longest common strings of each group."""
    r = random.Random(4)
    made = lambda n, size: [("".join(r.choice("ab" if k % 3 else "abcd") for _ in range(r.randint(1, size))).encode(), k % 4) for k in range(n)]
    for n, size in ((1, 5), (30, 40), (60, 300)):
        held, asked = made(n, size), made(20, size)
        split = lambda rows: (np.frombuffer(b"".join(x for x, _ in rows), np.uint8), np.cumsum([0, *(len(x) for x, _ in rows)]), np.array([g for _, g in rows]))
        index = run_length_index.Index(*split(held))
        assert len(index.start) == len(index.letter) == len(index.first_at) == len(index.last_at)
        got = index.match(*split(asked))
        want = [max([k for h, g in held if g == group for k in range(len(x) - p + 1) if x[p : p + k] in h], default=0) for x, group in asked for p in range(len(x))]
        assert got.tolist() == want


@pytest.mark.parametrize("size", [1 << 20, 700])
def test_repeats_of_one_task_equal_brute_force(size):
    """Keys in one task, some longer than an index may be, against a set of windows seen."""
    r = random.Random(12)
    s = run_length_index.Settings(length=9, index_bytes=size)
    rows = sorted((k % 5 if k % 2 else 7, k, "".join(r.choice("ab") for _ in range(r.randint(9, 30))).encode()) for k in range(160))
    task, seen, want = run_length_index.Task(s), defaultdict(set), set()
    for key, doc, x in rows:
        own = {x[p : p + 9] for p in range(len(x) - 8)}
        want |= {(doc, p + j) for p in range(len(x) - 8) if x[p : p + 9] in seen[key] for j in range(9)}
        seen[key] |= own
    column = lambda k: np.array([row[k] for row in rows])
    out = [*task.add(column(0), column(1), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.cumsum([0, *(len(x) for *_, x in rows)]), np.frombuffer(b"".join(x for *_, x in rows), np.uint8)), *task.flush()]
    got = {(d, p) for b in out for d, a, e in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True) for p in range(a, e)}
    assert got == want


def test_large_indexes_and_keys_of_many_parts():
    """An index of more rows than three ranks of 21 bits can tell apart, and a key longer than an index may be."""
    r = np.random.default_rng(2)
    line = r.integers(97, 101, 110).astype(np.uint8)
    rows = [np.concatenate([r.integers(97, 101, 60 + k % 7).astype(np.uint8), line, r.integers(97, 101, 60).astype(np.uint8)]) for k in range(21_000)]
    for k in range(18_000, 21_000, 3):
        rows[k] = np.concatenate([rows[k][:50], rows[k - 17_000][:150]])
    offsets, data = np.cumsum([0, *map(len, rows)]), np.concatenate(rows)
    index = run_length_index.Index(data, offsets, np.zeros(len(rows), np.int64))
    got = index.match(data[: offsets[500]], offsets[:501], np.zeros(500, np.int64))
    assert len(data) > 1 << 21 and got.tolist() == [n for x in rows[:500] for n in range(len(x), 0, -1)]
    task, seen, want = run_length_index.Task(run_length_index.Settings(index_bytes=1_500_000)), set(), set()
    for doc, x in enumerate(map(bytes, rows)):
        own = {x[p : p + 100]: p for p in range(len(x) - 99)}
        want |= {(doc, p + j) for w, p in own.items() if w in seen for j in range(100)}
        seen.update(own)
    ids, none = np.arange(len(rows)), np.zeros(len(rows), np.int64)
    out = [*task.add(none, ids, none, none, offsets, data), *task.flush()]
    assert len(task.earlier) > 1
    assert {(d, p) for b in out for d, a, e in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True) for p in range(a, e)} == want


def test_repeats_within_odd_rows(spark):
    """Null ids and texts, rows given twice, ids given twice, and a long text worked on in pieces."""
    r = random.Random(3)
    long = "".join(r.choice("abcdefgh") for _ in range(9000))
    rows = [(5, long), (5, long), (6, long[4000:4200] + "x" + long[100:8000]), (None, long[:150]), (None, None), (7, None), (7, long[:99]), (8, "ab" * 400), (9, "é" * 300)]
    s = run_length_index.Settings(piece_bytes=1000)
    got = sorted(((x.doc_id, x.n_bytes, x.n_removed, x.n_spans) for x in run_length_index.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), s=s).collect()), key=str)
    # Null ids come first, so that the start of the long text is known; rows that are wholly equal are one document.
    want = sorted([(5, 9000, 150, 1), (5, 9000, 150, 1), (6, 8101, 8100, 2), (None, 150, 0, 0), (None, 0, 0, 0), (7, 0, 0, 0), (7, 99, 0, 0), (8, 800, 798, 1), (9, 600, 598, 1)], key=str)
    assert got == want


# toxicity


def test_noisy_or_learns_sentences(spark):
    r = random.Random(6)
    rows, labels = [], []
    for k in range(300):
        sentences = [words(8, 1000 + k * 10 + j).capitalize() + "." for j in range(5)]
        bad = k % 4 == 0
        if bad:
            sentences[k % 5] = "You are a gribble fool."
        rows.append((k, " ".join(sentences)))
        labels.append((k, int(bad) if k != 9 else None))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string")
    model = toxicity_mil.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int").where("doc_id < 200"))
    got = {x.doc_id: x for x in toxicity_mil.score(docs, model).collect()}
    assert all((got[k].score >= 0.5) == (k % 4 == 0) for k in range(300))
    text = dict(rows)[204]
    assert [text[s.start : s.end].strip() for s in got[204].toxic_spans] == ["You are a gribble fool"]
    assert got[1000].score == got[1001].score < 0.5 and got[1000].n_sentences == 0


def hashed(word, prefixes=()):
    """The features of a word, one after the other."""
    data = np.frombuffer(word, np.uint8)
    one = lambda n: int(toxicity_mil.span_hashes_of(data)(np.array([0]), np.array([n]))[0])
    return [one(len(word)) ^ int(toxicity_mil.WHOLE), *(one(n) for n in prefixes if n <= len(word))]


def brute_score(text, model):
    """Noisy-or over the sentences, word by word."""
    fold = (text or "").encode().translate(toxicity_mil.FOLD)
    stay, n = 1 - model.leak, 0
    for part in fold.split(b"\n"):
        values = [sum(model.weights.get(x, 0.0) for x in hashed(w, model.prefixes)) for w in part.split()]
        n += bool(values)
        if any(values):
            stay *= 1 - 1 / (1 + np.exp(-min(30.0, max(-30.0, model.bias + sum(values)))))
    return 1 - stay, n


def test_scores_equal_brute_force(spark, docs):
    r = random.Random(8)
    model = toxicity_mil.Model({hashed(b"am0")[0]: 1.5, hashed(b"bk12", (4,))[1]: 2.5, hashed(b"ck3")[0]: -0.7, hashed("çirkin".encode())[0]: 3.0, hashed("çirk".encode(), (5,))[1]: 1.0, hashed(b"abcd", (4,))[1]: 0.5}, -1.5, 0.03, (4, 5, 6, 7, 8))
    rows = [(k, ("çirkin bir SÖZ! " if k % 3 == 0 else "") + "".join(r.choice(["Am0 ", "bk12. ", "ck3\n", "abcde! ", "é? ", "😀 ", "çirkince. ", "x" * 300 + " "]) for _ in range(r.randrange(40)))) for k in range(60)]
    rows += [(90, None), (91, ""), (92, "..!\n"), (93, rows[0][1]), (94, "zz " * 710_000 + "Am0 bk12.")]
    given = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("doc", F.lit(1))
    got = toxicity_mil.score(given, model).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "text", "doc", *toxicity_mil.RESULTS}
    for x in got:
        score, n = brute_score(x.text, model)
        assert abs(x.score - score) < 1e-9 and x.n_sentences == n
        for s in x.toxic_spans:
            assert abs(brute_score(x.text[s.start : s.end], toxicity_mil.Model(model.weights, model.bias, 0.0, model.prefixes))[0] - s.p) < 1e-9 and s.p >= 0.5
    assert toxicity_mil.score(docs.where("false"), model).count() == 0


def test_odd_labels_are_left_out(spark):
    rows = [(k, "bad word here." if k % 2 else "good text now.") for k in range(40)]
    labels = [(k, k % 2) for k in range(40)] + [(0, 7), (2, -1), (4, None), (None, 1)]
    model = toxicity_mil.train(spark.createDataFrame(rows * 2, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert brute_score("bad word here.", model)[0] > 0.5 > brute_score("good text now.", model)[0]


def test_toxicity_without_labels(spark, docs):
    model = toxicity_mil.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity_mil.score(docs, model, keep=["doc_id"]).collect()} == {0.0}


# importance resampling


def test_resampling_prefers_the_target(spark, docs):
    rows = [(k, words(60, k) if k % 3 else "zz " * 60) for k in range(120)] + [(500, None), (501, "")]
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(60)], "doc_id long, quality int")
    got = {r.doc_id: r for r in importance_resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), labels, importance_resampling.Settings(keep=0.5)).collect()}
    assert sum(r.kept for r in got.values()) == 61 and not any(got[k].kept for k in range(0, 120, 3))
    assert got[500].log_weight is None and not got[501].kept
    assert importance_resampling.resample(docs.where("false"), labels).count() == 0


def brute_weights(rows, good, words_=200.0):
    """Log weights by counting words and pairs of words in dictionaries of hashed buckets."""
    from berrak.llm import ngram_models
    from berrak.llm.textvec import BASE, U, mix, span_hashes

    def grams(text):
        one = []
        for w in (text or "").encode().split():
            data = np.frombuffer(w, np.uint8)
            one.append(span_hashes(data, np.array([0]), np.array([len(w)]))[0])
        with np.errstate(over="ignore"):
            two = [mix(np.array([a * BASE + b]))[0] for a, b in zip(one, one[1:])]
        return [int(x % U(ngram_models.BUCKETS)) for x in one + two]

    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t))
        target.update(grams(t) if i in good else [])
    log = lambda c, g: np.log((c[g] + 1) / (c.total() + ngram_models.BUCKETS))
    out = {}
    for i, t in rows:
        g = grams(t)
        out[i] = sum(log(target, x) - log(raw, x) for x in g) * min(1.0, words_ / len(g)) if g else None
    return out


def test_weights_equal_brute_force(spark):
    rows = [(k, words(20 + 11 * k, k)) for k in range(30)] + [(40, None), (41, ""), (42, " \n"), (43, "é ğ")]
    labels = [(k, int(k % 3 > 0)) for k in range(20)] + [(99, 1), (None, 1), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_words": F.lit("clash"), "doc": F.lit(1), "kept": F.lit(2)})
    got = {x.doc_id: x for x in importance_resampling.resample(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    want = brute_weights(rows, {i for i, q in labels if q == 1})
    assert set(got) == set(want)
    for k, w in want.items():
        assert got[k].log_weight is None if w is None else abs(got[k].log_weight - w) < 1e-6
    # 13 of the 20 labelled 0 to 19, and id 99, are good.
    share = 14 / 21
    keys = sorted((x.gumbel_key for x in got.values() if x.gumbel_key is not None), reverse=True)
    least = keys[round(share * len(rows)) - 1]
    assert {k for k, x in got.items() if x.kept} == {k for k, x in got.items() if x.gumbel_key is not None and x.gumbel_key >= least}


def test_resampling_without_good_labels(spark):
    rows = [(k, words(30, 1)) for k in range(20)] + [(20, "rare words only"), (20, "rare words only"), (21, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = importance_resampling.resample(docs, none).collect()
    assert all(x.log_weight == 0 and x.kept for x in got if x.doc_id != 21) and len(got) == len(rows)
    assert importance_resampling.good_share(none) == 1.0
    bad = spark.createDataFrame([(1, 0), (2, 0), (2, 5)], "doc_id long, quality int")
    assert importance_resampling.good_share(bad) == 0.0 and not any(x.kept for x in importance_resampling.resample(docs, bad).collect())


def test_kth_largest(spark):
    values = [random.Random(1).gauss(0, 1) for _ in range(500)] + [3.0] * 50
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    for k in (1, 10, 300, 9999):
        assert importance_resampling.kth_largest(df, "v", k, importance_resampling.Settings(bins=8, few=5)) == sorted(values, reverse=True)[min(k, len(values)) - 1]


# mixing


def test_rates_meet_targets(spark):
    r = np.random.default_rng(1)
    p = r.dirichlet([0.4, 0.4, 0.4], 400)
    n = r.integers(1, 500, 400)
    rows = spark.createDataFrame([(int(k), list(map(float, q))) for k, q in zip(n, p, strict=True)], "n_tokens long, posterior array<double>")
    s = soft_mixing.Settings(targets={"a": 0.7, "b": 0.2, "c": 0.1})
    rate, left = soft_mixing.solve(rows, s)
    got = rows.select(rate.alias("r"), "n_tokens", "posterior").toPandas()
    sums = (np.stack(got["posterior"]) * (got["r"] * got["n_tokens"]).to_numpy()[:, None]).sum(0) / n.sum()
    assert np.allclose(sums, [0.7, 0.2, 0.1], atol=1e-3) and (got["r"] >= 0).all() and max(map(abs, left.values())) < 1e-3


def brute_posteriors(rows, labelled, s):
    """Naive Bayes by dictionaries over the same hashed buckets."""
    from berrak.llm import ngram_models

    names = s.domains
    counts = {n: Counter() for n in names}
    had = Counter(labelled.values())
    weights = {}
    for i, t in rows:
        offsets = np.array([0, len((t or "").encode())])
        weights[i] = ngram_models._buckets(np.frombuffer((t or "").encode(), np.uint8), offsets, s.buckets)[0].tolist() if t else []
        if i in labelled:
            counts[labelled[i]].update(weights[i])
    out = {}
    for i, _ in rows:
        g = weights[i]
        logit = np.array([sum(np.log((counts[n][x] + 1) / (counts[n].total() + s.buckets)) for x in g) * (min(1.0, s.words / len(g)) if g else 0) + np.log((had[n] + 1) / (had.total() + len(names))) for n in names])
        out[i] = np.exp(logit - logit.max()) / np.exp(logit - logit.max()).sum()
    return out


def test_posteriors_equal_brute_force(spark):
    rows = [(k, words(10 + 9 * k, k % 5)) for k in range(24)] + [(30, None), (31, "")]
    labelled = {k: ("clean", "low", "toxic")[k % 3] for k in range(15)}
    s = soft_mixing.Settings(words=20.0, buckets=512)
    table = spark.createDataFrame(list(labelled.items()), "doc_id long, domain string")
    mixed = soft_mixing.mix(spark.createDataFrame(rows, "doc_id long, text string"), table, ["doc_id"], s).collect()
    want = brute_posteriors(rows, labelled, s)
    assert all(np.allclose(x.posterior, want[x.doc_id], atol=1e-9) for x in mixed)
    total = sum(x.n_tokens for x in mixed)
    got = sum(x.n_tokens * x.rate * np.array(x.posterior) for x in mixed) / total
    assert np.allclose(got, [s.targets[n] for n in s.domains], atol=1e-4)
    assert all(x.copies in (int(x.rate), int(x.rate) + 1) for x in mixed)


def test_mixing_with_clashing_names(spark):
    rows = [(k if k % 5 else None, words(30, k)) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("n_words", "n_grams", "log_sums", "parts", "doc", "own", "draw", "rate", "a.b")})
    labelled = spark.createDataFrame([(1, "clean"), (2, "low"), (3, "toxic")], "doc_id long, domain string")
    got = soft_mixing.mix(docs, labelled).collect()
    assert len(got) == 40 and got[0].parts == "parts" and got[0]["a.b"] == "a.b" and got[0].rate >= 0
    assert soft_mixing.mix(docs, labelled, []).columns == ["n_tokens", "posterior", "rate", "copies"]
    assert soft_mixing.mixing_stage(docs, labelled).columns == docs.columns
    # Null ids are drawn by their texts, so that they don't all share one chance.
    half = soft_mixing.Settings(targets={"clean": 0.5, "low": 0.25, "toxic": 0.25})
    assert len({x.copies for x in soft_mixing.mix(docs, labelled, s=half).collect() if x.doc_id is None}) >= 1


def test_mixing_handles_odd_rows(spark, docs, empty):
    labelled = soft_mixing.domains_of_labels(spark.createDataFrame([(1, 1, 0), (9, 0, 0), (10, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int"))
    mixed = soft_mixing.mix(docs.drop("kept"), labelled)
    assert mixed.count() == len(DOCS) and mixed.where("rate < 0 or rate is null").count() == 0
    assert soft_mixing.mixing_stage(docs, labelled).columns == docs.columns
    assert soft_mixing.mixing_stage(empty, labelled).count() == 0


# sharding


def test_table_is_even_and_stable():
    shards = {f"s{k}": 1 for k in range(7)}
    full = sharding.fill(shards, 1009)
    assert max(Counter(full).values()) - min(Counter(full).values()) <= 1
    less = sharding.fill({k: v for k, v in shards.items() if k != "s3"}, 1009)
    moved = sum(a != b for a, b in zip(full, less, strict=True) if a != "s3")
    assert moved < 0.2 * 1009
    heavy = Counter(sharding.fill({"a": 3, "b": 1}, 1009))
    assert abs(heavy["a"] - 3 * heavy["b"]) <= 4
    with pytest.raises(ValueError):
        sharding.fill(shards, 1000)


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1, "c": 1}, {"x": 3, "y": 1, "z": 0, "w": 2}])
def test_fill_equals_brute_force(weights):
    """Whole preference lists written out, and turns taken over them."""
    size = 101
    number = lambda name, salt: int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")
    lists = {n: [(number(n, "offset") + k * (number(n, "skip") % (size - 1) + 1)) % size for k in range(size)] for n, w in weights.items() if w}
    want = {}
    while len(want) < size:
        for n in sorted(lists):
            for _ in range(weights[n]):
                slot = next((x for x in lists[n] if x not in want), None)
                if slot is not None:
                    want[slot] = n
    assert sharding.fill(weights, size) == [want[k] for k in range(size)]
    assert all(sorted(x) == list(range(size)) for x in lists.values())


def test_placement(docs, empty):
    got = sharding.place(docs).collect()
    assert len(got) == len(DOCS) and all(r.shard for r in got)
    table = sharding.fill()
    assert all(table[r.slot] == r.shard for r in got)
    assert len({r.shard for r in got if r.doc_id == 12}) == 1
    assert sharding.place(empty).count() == 0


# web archives


def test_derivatives_are_linked(spark):
    pages = spark.createDataFrame([(1, "http://a/\r\nX: y", "<html><title>T &amp; t</title><script>var a='<p>';</script><p>One<br>two &lt;3</p><!-- no --></html>"), (2, None, None), (3, "http://b", "")], "page_id long, url string, html string")
    source = warc_derive.responses(pages)
    rows = warc_derive.derive(source, ("page_id",)).collect()
    ids = {r.page_id: r.record_id for r in source.collect()}
    assert len(rows) == 6 and all(r.refers_to == ids[r.page_id] for r in rows) and len({r.record_id for r in rows}) == 6
    for r in rows:
        head, _, body = r.record.partition("\r\n\r\n")
        assert f"WARC-Refers-To: {r.refers_to}" in head and r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest()
        assert body == r.block + "\r\n\r\n" and r.content_length == len(r.block.encode()) and "\r\nX: y" not in head
    assert next(r.block for r in rows if r.page_id == 1 and r.record_type == "conversion") == "T & t\nOne\ntwo <3"


def test_derivatives_of_odd_pages(spark):
    """What nothing closes stays, in linear time; white space collapses; repeated responses give repeated records."""
    cases = [("a<!-- b <!-- c", "a<!-- b <!-- c"), ("a<!--b-->c<!--", "ac<!--"), ("x<script>y", "xy"), ("x<SCRIPT>y</script >z<style", "xz<style"), ("x <p y", "x <p y"), (" <b>x \t\n</b>  y <br> z\n", "x  y\nz"), (" \n ", "")]
    cases += [(bad * 200_000, None) for bad in ("<!--", "<script>", "<script", "<p ", "<title>", " <b>")]
    pages = spark.createDataFrame([(k, "u", x) for k, (x, _) in enumerate(cases)] + [(0, "u", cases[0][0])], "page_id long, url string, html string")
    rows = warc_derive.derive(warc_derive.responses(pages), ("page_id",)).where("record_type = 'conversion'").collect()
    assert len(rows) == len(cases) + 1 and len({r.record_id for r in rows}) == len(cases)
    assert {r.page_id: r.block for r in rows if cases[r.page_id][1] is not None} == {k: y for k, (_, y) in enumerate(cases) if y is not None}
    assert warc_derive.derive(warc_derive.responses(pages.limit(0))).count() == 0


def test_derivatives_with_clashing_names(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a")], "page_id long, url string, html string")
    source = warc_derive.responses(pages).withColumns({"text": F.lit("t"), "block": F.lit("b"), "id": F.lit(7)})
    keep = ("page_id", "date", "text", "block", "id", "payload")
    out = warc_derive.derive(source, keep)
    assert out.columns[:6] == ["page_id", "source_date", "source_text", "source_block", "source_id", "source_payload"] and len(set(out.columns)) == len(out.columns)
    row = out.where("record_type = 'conversion'").first()
    assert (row.source_text, row.source_block, row.source_id, row.source_payload, row.block) == ("t", "b", 7, "<p>a", "a")
    assert out.drop(*out.columns[1:6]).exceptAll(warc_derive.derive(source, ("page_id",))).count() == 0


# queries and pipeline


@pytest.mark.parametrize("name", list(QUERIES))
def test_queries_return_every_row(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    table, key, times = {"op5": ("pages", "page_id", 2), "op8": ("conversations", "conv_id", 1)}.get(name[:3], ("documents", "doc_id", 1))
    source = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    want = source.select(key).distinct().count() + 1 if name.startswith("op8") else source.count() * times
    assert got.count() == want


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == [*docs.columns, "slot", "shard"]
    got = out.toPandas()
    assert 0 < len(got) <= 2 * docs.count()
    left = decontaminate.scan(out.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    assert left.where("contaminated").count() == 0
