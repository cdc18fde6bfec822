"""Training-data operators against brute force, round trips and edge cases."""

import collections
import hashlib
import heapq
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import bpe, common, hnsw, langid, lines, minhash, mixing, nndescent, pii, sharding, suffixes
from quillspark.llm.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"
EDGE = [(1, None, "en", None), (2, "", None, "a"), (3, "!!! 123", "en", "a"), (4, "one", "en", "a"), (5, "one", "en", "b"), (5, "one", "en", "b"), (6, "word " * 3000, "fr", "c"), (7, "word " * 3000, "fr", "c"), (8, "línea\nlínea\n\nx", "es", "c")]


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, repeated rows, and columns that clash with names used inside."""
    docs = spark.createDataFrame(EDGE, "doc_id long, text string, lang string, source string")
    return docs.select("*", *[F.lit(0).alias(c) for c in ("id", "size", "key", "n_words", "t1", "node", "at", "label_b")])


@pytest.fixture(scope="module")
def none(edge):
    return edge.limit(0)


@pytest.fixture(scope="module")
def prose(spark):
    """Random texts with exact copies, near copies and shared passages."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    passage = " ".join(r.choice(words) for _ in range(70))
    texts = []
    for i in range(120):
        t = [r.choice(words) for _ in range(r.randint(1, 160))]
        if i % 9 == 0:
            t = t[:10] + [passage] + t[10:]
        if i % 5 == 1 and texts:
            t = r.choice(texts).split(" ")
            for _ in range(r.randint(0, 3)):
                t[r.randrange(len(t))] = r.choice(words)
        texts.append(" ".join(t) if i % 4 else " ".join(t[: len(t) // 2]) + "\n" + " ".join(t[len(t) // 2 :]))
    texts += [None, "", "é" * 250, "é" * 250 + "x"]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def words_of(t):
    return (t or "").encode().lower().split()


def test_every_query_runs(spark):
    assert {f"op{n}_" for n in range(1, 11)} == {q.partition("_")[0] + "_" for q in QUERIES}
    for name in SQL:
        con = duckdb.connect()
        con.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
        got, want = QUERIES[name](spark, SMALL).toPandas(), con.execute(SQL[name]).df()
        key = lambda d: sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in row) for row in d[sorted(d.columns)].itertuples(index=False))
        assert key(got) == key(want)


# ---- lines


def test_lines(spark, prose, edge, none):
    got = {r.doc_id: r for r in lines.deduplicate_lines(prose).collect()}
    seen, kept = set(), {}
    for r in prose.orderBy("doc_id").collect():  # exact repeats at least
        for line in (r.text or "").split("\n"):
            n = line.strip(" ").lower()
            kept.setdefault(r.doc_id, []).append(not n or n not in seen)
            seen.add(n)
    for i, k in kept.items():
        assert got[i].n_removed >= sum(not x for x in k)
    assert lines.deduplicate_lines(none).count() == 0
    out = {r.doc_id: r for r in lines.deduplicate_lines(edge).collect()}
    assert out[1].text is None and out[1].n_lines == 0 and out[8].text == "línea\n\nx" and out[8].n_removed == 1
    assert lines.deduplicate_lines(edge).count() == len(EDGE)


def test_fuzzy_lines(spark):
    base = " ".join(f"token{i}" for i in range(60))
    docs = spark.createDataFrame([(1, base), (2, base.replace("token7 ", "tokem7 ")), (3, "something else altogether here"), (4, base + "\nnew")], "doc_id long, text string")
    near = {r.doc_id: r.text for r in lines.deduplicate_lines(docs).collect()}
    assert near[1] == base and near[3] == "something else altogether here" and near[4] == "new"
    rows = docs.select(F.col("doc_id").alias("id"), "text").collect()
    assert rows


def test_near_lines_against_edit_counts(spark):
    """Every pair with edit similarity 0.8 is found, counted by brute force: short, spaced, unspaced and long lines."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8)))
    base = [" ".join(word() for _ in range(n)) for n in (2, 3, 4, 8, 10, 12, 20, 40, 300) for _ in range(3)]
    base += ["".join(chr(0x4E00 + r.randrange(3000)) for _ in range(n)) for n in (10, 40, 80) for _ in range(3)]
    texts = []
    for b in base:
        c = list(b)
        for i in r.sample(range(1, len(c) - 1), max(1, len(c) // 12)):
            c[i] = "z"
        texts += [b, "".join(c)]
    texts += [" ".join(word() for _ in range(10)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = docs.selectExpr("doc_id a", "text ta").crossJoin(docs.selectExpr("doc_id b", "text tb")).where("a < b and levenshtein(ta, tb) * 100 <= greatest(length(ta), length(tb)) * 20")
    parent = list(range(len(texts)))
    for x in sorted(pairs.select("a", "b").collect()):
        lo, hi = sorted((parent[x.a], parent[x.b]))
        parent = [lo if p == hi else p for p in parent]
    want = {i for i, p in enumerate(parent) if p != i}
    assert len(want) >= len(base)
    assert {x.doc_id for x in lines.deduplicate_lines(docs).where("n_removed > 0").collect()} == want


def test_lines_as_in_op1_against_brute_force(spark):
    """Lines removed with the parameters of op1 from whole documents, against all pairs of lines."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = lines._normalised(lines._split_lines(docs.withColumnRenamed("doc_id", "id"))).select("norm").distinct()
    norms = sorted(x.norm for x in rows.collect())
    table = spark.createDataFrame(list(enumerate(norms)), "i long, t string").repartition(16)
    pairs = table.selectExpr("i a", "t ta", "length(t) la").crossJoin(table.selectExpr("i b", "t tb", "length(t) lb")).where("a < b and abs(la - lb) * 100 <= greatest(la, lb) * 20")
    near = pairs.where("levenshtein(ta, tb, cast(floor(greatest(la, lb) * 0.2) as int)) >= 0").select("a", "b").collect()
    parent = list(range(len(norms)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in near:
        a, b = find(x.a), find(x.b)
        parent[max(a, b)] = min(a, b)
    group = {t: find(i) for i, t in enumerate(norms)}
    counts = collections.Counter(group[x.norm] for x in lines._normalised(lines._split_lines(docs.withColumnRenamed("doc_id", "id"))).select("norm").collect())
    want = sum(n - 1 for n in counts.values())
    got = lines.deduplicate_lines(docs, taken=lines.TAKEN, shared=lines.SHARED, least_bytes=lines.LEAST_BYTES).agg(F.sum("n_removed")).first()[0]
    assert len(near) > 5 and 0.98 * want <= got <= want


def test_scattered_edits_as_in_op1(spark):
    """Lines that share no word pairs, or few, are linked with the parameters of op1 too: short, spaced, unspaced and long ones."""
    r = random.Random(23)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8)))
    base = [" ".join(word() for _ in range(n)) for n in (2, 3, 8, 10, 20, 40, 300) for _ in range(2)] + ["".join(chr(0x4E00 + r.randrange(3000)) for _ in range(n)) for n in (10, 80) for _ in range(2)]
    texts = []
    for b in base:
        c = list(b)
        for i in range(2, len(c) - 2, 6):
            c[i] = "z"
        texts += [b, "".join(c)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = lines.deduplicate_lines(docs, taken=lines.TAKEN, shared=lines.SHARED, least_bytes=lines.LEAST_BYTES)
    near = docs.selectExpr("doc_id a", "text ta").join(docs.selectExpr("doc_id b", "text tb"), F.expr("a + 1 = b and a % 2 = 0 and levenshtein(ta, tb) * 100 <= greatest(length(ta), length(tb)) * 20"))
    want = {x.b for x in near.collect()}
    assert len(want) == len(base)
    assert {x.doc_id for x in got.where("n_removed > 0").collect()} == want


def test_edit_similar_is_exact(spark):
    r, rows = random.Random(5), []
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 6)))
    for _ in range(1500):
        a = [word() for _ in range(r.randint(1, 14))]
        b = list(a)
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(b)) if b else 0
            b[k : k + r.randint(0, 1)] = [word()] * r.randint(0, 1)
        rows.append((len(rows), " ".join(a), " ".join(b) or "a"))
    d = spark.createDataFrame(rows, "i long, a string, b string")
    want = {x.i for x in d.where("levenshtein(a, b) <= floor(greatest(length(a), length(b)) * 0.2)").collect()}
    assert want and {x.i for x in d.where(lines.edit_similar("a", "b", 80)).collect()} == want


def test_outlines_take_no_more_edits(spark):
    """The edits of two outlines are no more than those of the lines, whatever is put in, left out or replaced."""
    r, rows = random.Random(31), []
    for _ in range(1500):
        a = [r.choice("aeiou\u00e9\u0435bdkz \u043a\u4e2d7") for _ in range(r.randint(0, 40))]
        b = list(a)
        for _ in range(r.randint(0, 6)):
            k = r.randint(0, len(b))
            b[k : k + r.randint(0, 1)] = [r.choice("aeobz ")] * r.randint(0, 1)
        rows.append(("".join(a), "".join(b)))
    d = spark.createDataFrame(rows, "a string, b string")
    d = d.selectExpr("levenshtein(a, b) edits", f"levenshtein({lines._outline('a')}, {lines._outline('b')}) outlined", "length(a) n")
    assert d.where("outlined > edits").count() == 0 and d.where("outlined > 0 and n > 9").count() > 500


def test_exact_step_stores_texts_once(spark):
    r = random.Random(37)
    texts = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(1000)) for _ in range(400)]
    with common.scope(spark) as tables:
        table = tables.store(spark.createDataFrame(list(enumerate(texts)), "node long, norm string"))
        found = lines._links_between(tables, table, table.selectExpr("node", "0L as component"), 80)
        assert found.count() == 0
        folders = [f.removeprefix("file:") for f in tables.folders]
        stored = sum(os.path.getsize(os.path.join(at, f)) for folder in folders for at, _, names in os.walk(folder) for f in names)
        assert 0 < stored < 1.5 * sum(map(len, texts))


def test_exact_step_counts_characters_in_compiled_code(spark, monkeypatch):
    """Counts are those of the characters, and no generated method is beyond the 8,000 bytes that the JVM compiles."""
    r, sizes, counted = random.Random(41), [], {}
    texts = ["".join(r.choice("abcdefgz \u00e9\u4e2d\U00020000\U0001f600") for _ in range(r.randint(1, 60))) for _ in range(50)]
    store = common.Scope.store

    def watched(self, df):
        out = store(self, df)
        if "c0" in df.columns:
            stages = df._jdf.queryExecution().debug().codegenToSeq().iterator()
            while stages.hasNext():
                sizes.append(stages.next()._3().maxMethodCodeSize())
            counted.update({x.norm: [x[f"c{i}"] for i in range(lines.COUNTS)] for x in out.collect()})
        return out

    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the code is not known before the job runs
    try:
        with common.scope(spark) as tables:
            table = tables.store(spark.createDataFrame(list(enumerate(texts)), "node long, norm string"))
            monkeypatch.setattr(common.Scope, "store", watched)
            lines._links_between(tables, table, table.selectExpr("node", "0L as component"), 80)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    for t in texts:
        kinds = collections.Counter(ord(c) % lines.COUNTS for c in t)
        assert counted[t] == [kinds[i] for i in range(lines.COUNTS)]
    assert sizes and max(sizes) <= 8000


def test_lines_alike_but_for_punctuation(spark):
    rows = [(1, "und aebe.\nx"), (2, "und | aebe.\r\ny"), (3, "und###\taebe!!"), (4, "-----\n\r\n\t"), (5, "-----\r\n\r\n\t"), (None, "\u0915\u093f \u0916\nonly here, once again"), (None, "\u0915\u0940 \u0916"), (7, "only here, once agair")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_lines): r.text for r in lines.deduplicate_lines(docs).collect()}
    assert got[1, 2] == "und aebe.\nx" and got[2, 2] == "y" and got[3, 1] == ""
    assert got[5, 3] == "\r\n\t" and got[4, 3] == "-----\n\r\n\t"
    assert got[None, 1] == rows[6][1] and got[None, 2] == rows[5][1] and got[7, 1] == ""


# ---- mixing and sharding


def test_mix(edge, none):
    rows = mixing.mix(edge).collect()
    assert len(rows) == len(EDGE) and mixing.mix(none).count() == 0
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert 0 <= r.taken <= 2 * r.size
    for group in by.values():
        assert abs(sum(r.taken for r in group) - group[0].target) <= 0.5
        assert sum(r.size for r in group) == group[0].source_size


def test_repeated(spark):
    docs = spark.createDataFrame([(i, "w " * (i + 1), "s") for i in range(20)], "doc_id long, text string, source string")
    plan = mixing.mix(docs)
    want = sum(-(-r.taken // r.size) for r in plan.collect())
    assert mixing.repeated(docs, plan).count() == want


def plain_longest_first(sizes, n):
    """Every group by itself through a heap: loads of the shards, and for each size how many a shard gets."""
    heap, dealt, loads = [(0, i) for i in range(n)], {}, [0] * n
    for size in sorted(sizes, reverse=True):
        load, i = heapq.heappop(heap)
        dealt.setdefault(size, [0] * n)[i] += 1
        loads[i] = load + size
        heapq.heappush(heap, (load + size, i))
    return loads, dealt


def test_longest_first():
    r = random.Random(2)
    for turn in range(150):
        n = r.choice([1, 2, 3, 5, 16])
        counts = [(size, r.choice([1, 2, 7, 50, 500, 2000])) for size in r.sample(range(1, 200 if turn % 2 else 5000), r.randint(1, 30))]
        assert dict(sharding.longest_first(counts, n)) == plain_longest_first([size for size, c in counts for _ in range(c)], n)[1]
    assert sharding.longest_first([], 3) == []


def test_shards_against_plain(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PLENTY", 20)
    texts = ["x" * (i % 40) + str(i % 300) for i in range(900)] + ["hot " * 4000] * 5 + [None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    loads = [0] * 8
    for row in sharding.shard_documents(docs, n_shards=8).collect():
        loads[row.shard] += row["size"]
    groups = collections.Counter()
    for t in texts:
        groups[t or ""] += len((t or "").encode()) + 1
    assert loads == plain_longest_first(list(groups.values()), 8)[0]  # one group is far above a fair share


def test_shards(spark, edge, none):
    rows = sharding.shard_documents(edge, n_shards=4).collect()
    assert len(rows) == len(EDGE) and sharding.shard_documents(none).count() == 0
    shards = collections.defaultdict(set)
    for r, (_, text, _, _) in zip(sorted(rows, key=lambda r: (r.doc_id, r.slot)), sorted(EDGE, key=lambda x: x[0]), strict=True):
        shards[text or ""].add(r.shard)
        assert r["size"] == len((text or "").encode()) + 1
    assert all(len(s) == 1 for s in shards.values())
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    even = spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.col("id").cast("string"), (F.col("id") % 50).cast("int")).alias("text"))
    loads = [r[1] for r in sharding.shard_documents(even).groupBy("shard").agg(F.sum("size")).collect()]
    assert len(loads) == 16 and max(loads) < 1.02 * min(loads)


# ---- near duplicates


def brute_groups(sets, percent):
    ids, parent = sorted(sets), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("n", [4, 5])
def test_minhash(prose, edge, none, n):
    sets = {}
    for r in prose.collect():
        w = words_of(r.text)
        sets[r.doc_id] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    want = brute_groups(sets, 80)
    for r in minhash.near_duplicates(prose, n=n).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert minhash.near_duplicates(none).count() == 0
    out = {r.doc_id: r for r in minhash.near_duplicates(edge, n=n).collect()}
    assert out[1].n_shingles == 0 and out[1].component_id == 1 and out[5].component_id == 4 and out[7].component_id == 6


def test_minhash_large_group(spark):
    """A group in which not all are linked goes through blocks."""
    r = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(90):
        t = list(base)
        for _ in range(r.randint(0, 7)):
            t[r.randrange(120)] = f"x{r.random()}"
        texts.append(" ".join(t))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_groups({i: {tuple(t.split()[k : k + 5]) for k in range(116)} for i, t in enumerate(texts)}, 80)
    assert {x.doc_id: x.component_id for x in minhash.near_duplicates(docs).collect()} == want


def test_block_links():
    r = np.random.default_rng(2)
    base = np.unique(r.integers(0, 1 << 60, 500).astype(np.uint64))
    sets = [np.unique(np.concatenate((base[r.random(len(base)) < 0.93], r.integers(0, 1 << 60, 5).astype(np.uint64)))) for _ in range(40)]
    groups = brute_groups({i: set(s.tolist()) for i, s in enumerate(sets)}, 80)
    found = minhash.links_within(np.arange(40), sets, 80)
    parent = list(range(40))
    for a, b in found:
        parent = [min(parent[a], parent[b]) if p in (parent[a], parent[b]) else p for p in parent]
    assert parent == [groups[i] for i in range(40)]


# ---- repeated strings


def test_suffixes(prose, edge, none):
    def brute(texts):
        seen = collections.Counter()
        for b in texts:
            seen.update(b[p : p + 200] for p in range(len(b) - 199))
        for b in texts:
            gone = [False] * len(b)
            for p in range(len(b) - 199):
                if seen[b[p : p + 200]] > 1:
                    gone[p : p + 200] = [True] * 200
            yield len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), bytes(x for x, g in zip(b, gone, strict=True) if not g)

    for docs in (prose, edge):
        rows = docs.collect()
        want = sorted((r.doc_id, *w) for r, w in zip(rows, brute([(r.text or "").encode() for r in rows]), strict=True))
        got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(docs).collect())
        assert got == want
    assert suffixes.remove_repeats(none).count() == 0


def test_suffixes_across_segments(monkeypatch):
    monkeypatch.setattr(suffixes, "_SEGMENT", 1000)
    data = np.random.default_rng(1).integers(97, 100, 5000).astype(np.uint8).tobytes()
    covered = np.zeros(len(data) - 199, int)
    for part, ends, _, begins in suffixes._segments([data]):
        _, first, last, _, _, _ = suffixes._anchors(part, ends)
        for a, b in zip(first, last, strict=True):
            covered[begins[0] + a : begins[0] + b + 1] += 1
    assert (covered == 1).all()


# ---- language


def test_language(spark, edge, none):
    got = QUERIES["op7_language_id"](spark, SMALL.replace("0.001", "0.01")).join(spark.read.parquet(SMALL.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()
    model = langid.train(edge, "text", "lang", "doc_id", F.lit(True))
    out = {r.doc_id: r for r in langid.predict(edge, model).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and out[6].lang_pred == "fr"
    assert langid.train(none, "text", "lang", "doc_id", F.lit(True)) is None
    assert {r.lang_pred for r in langid.predict(edge, None).collect()} == {"und"} and langid.predict(none, model).count() == 0


def test_language_against_plain_bayes(spark):
    """Scores and fit, counted with dictionaries."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").where("lang is not null")
    model = langid.train(docs, "text", "lang", "doc_id", F.lit(True))
    texts = collections.defaultdict(list)
    for r in docs.collect():
        texts[r.lang].append(r.text)
    grams = lambda t: [int(g) for part in langid._grams(langid._codes(t)) for g in part]
    counts = {lang: collections.Counter(g for t in own for g in grams("\n".join([t]))) for lang, own in texts.items()}
    n_docs = sum(map(len, texts.values()))

    def points(text):
        out = {}
        for lang, c in counts.items():
            total = sum(c.values()) + 0.1 * 65536
            out[lang] = np.log(len(texts[lang]) / n_docs) + sum(np.log((c[g] + 0.1) / total) for g in grams(text))
        return out

    asked = docs.where("length(text) < 600").limit(25)
    for r in langid.predict(asked, model).collect():
        p = points(r.text)
        assert r.lang_pred == max(p, key=p.get)
        assert abs(r.score - 1 / sum(np.exp(v - max(p.values())) for v in p.values())) < 1e-3


def test_fit_tells_language_from_noise(spark):
    docs = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet")
    model = langid.train(docs, "text", "lang", "doc_id", F.lit(True))
    r = random.Random(1)
    noise = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)) for n in (10, 30, 100, 300) for _ in range(30)] + ["Это обычное русское предложение", "日本語の文章です"]
    out = langid.predict(spark.createDataFrame([(t,) for t in noise], "text string"), model)
    assert out.where("fit >= 0.5").count() == 0
    assert langid.predict(docs, model).where("fit < 0.5").count() == 0


# ---- BPE


def test_bpe(spark, edge, none):
    import tiktoken

    data, pattern = bpe.vocabulary()
    coder = bpe.Codec(bpe.parse_ranks(data), pattern)
    tk = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.parse_ranks(data), special_tokens={})
    r = random.Random(4)
    texts = [row.text for row in spark.read.parquet(f"{SMALL}/documents.parquet").collect()] + ["<|endoftext|>", "a" * 3000]
    texts += ["".join(r.choice("abcé漢🙂 \n\t'0.!") for _ in range(r.randint(0, 80))) for _ in range(500)]
    for text in texts:
        ids = coder.encode(text)
        assert ids == tk.encode_ordinary(text)
        assert "".join(coder.decode_chunks(ids, 3)) == text
    for piece in {p for t in texts for p in coder.split(t)}:
        raw = piece.encode()
        if raw not in coder.transducer.ranks:
            assert coder.transducer.simulate(raw) == bpe.merge_bytes(coder.transducer.ranks, raw) == coder.transducer.encode(raw)
    rows = bpe.encode_documents(edge).collect()
    assert len(rows) == len(EDGE) and bpe.encode_documents(none).count() == 0
    assert [x.n_tokens for x in rows if x.doc_id in (1, 2)] == [0, 0]
    assert next(x for x in rows if x.doc_id == 8).decoded_sha256 == hashlib.sha256("línea\nlínea\n\nx".encode()).hexdigest()


def test_small_vocabulary():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"cd": 259, b"abcd": 260}
    t = bpe.Transducer(ranks)
    r = random.Random(2)
    for _ in range(500):
        piece = bytes(r.choice(b"abcd") for _ in range(r.randint(1, 12)))
        if piece not in ranks:
            assert t.encode(piece) == bpe.merge_bytes(ranks, piece) == t.simulate(piece)
    single = [bytes([i]) for i in range(256)]
    for _ in range(300):  # a byte at a time, cut and broken characters included, as all at once
        raw = "é漢🙂a".encode()[r.randint(0, 3) :][: r.randint(1, 9)] + bytes(r.choice((0x41, 0x80, 0xC3, 0xE2, 0xF0, 0xFF)) for _ in range(r.randint(0, 4)))
        decoder = bpe.Decoder(single)
        assert "".join([decoder.feed([b]) for b in raw]) + decoder.close() == raw.decode("utf-8", "replace")


# ---- vectors

VECTORS = [(1, [1.0, 0.0], 1), (2, [2.0, 0.01], 1), (3, [0.0, 0.0], 1), (4, None, 1), (5, [float("nan"), 1.0], 1), (6, [1.0, 0.0], None), (7, [1.0, 0.0], 2), (8, [1.0, None], 1), (9, [-1.0, 0.0], 1), (10, [], 1)]


def test_vectors(spark):
    r = np.random.default_rng(7)
    x = r.normal(size=(600, 16))
    x[300:340] = x[300] + 0.02 * r.normal(size=(40, 16))
    x[400] = x[5]
    rows = [(i, v.tolist(), int(i % 3 if i < 300 else 0)) for i, v in enumerate(x)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    stored = np.array([row.embedding for row in d.orderBy("vec_id").collect()])
    unit = stored / np.linalg.norm(stored, axis=1, keepdims=True)
    label = np.array([row[2] for row in rows])
    linked = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    for size in (16384, 100):
        got = {g.vec_id: g for g in hnsw.near_duplicate_vectors(d, shard_rows=size).collect()}
        assert [got[i].n_links for i in range(600)] == linked.sum(1).tolist()
        assert got[339].component_id == 300 and got[400].component_id == (5 if label[5] == 0 else 400)
    out = {g.vec_id: (g.n_links, g.component_id, g.kept) for g in hnsw.near_duplicate_vectors(spark.createDataFrame(VECTORS, d.schema)).collect()}
    assert out[2] == (1, 1, False) and all(out[i] == (0, i, True) for i in range(3, 11))
    assert hnsw.near_duplicate_vectors(d.limit(0)).count() == 0


def test_nearest(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(1500, 12)).astype(np.float32).astype(float)
    d = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, rank int")
    got = collections.defaultdict(list)
    for row in nndescent.nearest(d, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[row.query_id].append((row.vec_id, row.score))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 1500, 50):
        s = unit @ unit[q]
        s[q] = -2
        hits += len({v for v, _ in got[q]} & set(np.argsort(-s)[:5].tolist()))
        assert all(abs(score - s[v]) < 1e-12 for v, score in got[q])
    assert hits >= 0.95 * 150
    few = spark.createDataFrame([(0, [1.0, 0.0], 1), (50, [1.0, 1.0], 1), (3, [2.0, 0.0], 1), (4, None, 1), (5, [0.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    rows = [tuple(row)[:3] for row in nndescent.nearest(few, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert rows == [(0, 1, 3), (0, 2, 50), (50, 1, 0), (50, 2, 3)]
    assert nndescent.nearest(few.limit(0), F.lit(True)).count() == 0


def test_graph_of_a_large_label(monkeypatch):
    """Thousands of vectors of one label: the graph is searched, beams widen, and the links are those of a full scan."""
    r = np.random.default_rng(1)
    x = r.normal(size=(5000, 32))
    for c in range(30):
        x[c * 100 : c * 100 + 100] = x[c * 100] + 0.1 * r.normal(size=(100, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, beams, plain = hnsw.Graph(x.astype(np.float32), np.arange(5000)), [], hnsw.Graph.search
    monkeypatch.setattr(hnsw.Graph, "search", lambda self, q, beam: beams.append(beam) or plain(self, q, beam))
    found = {(int(a), int(b)) for q, node in hnsw.links_of(graph, x, x, np.arange(5000), 0.9) for a, b in zip(q, node, strict=True)}
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(x @ x.T >= 0.9), strict=True)}
    assert found <= want and len(found) >= 0.999 * len(want) and hnsw.BEAM in beams and max(beams) > hnsw.BEAM


def test_nearest_among_copies(spark):
    """Recall against brute force with a large group of equal vectors, one of near copies, and very large components."""
    r = np.random.default_rng(3)
    x = r.normal(size=(2000, 16))
    x[::5] = x[0]
    x[1001:1400:2] = x[1] + 0.002 * r.normal(size=(200, 16))
    x[100] *= 1e200
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for row in nndescent.nearest(d, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        assert np.isfinite(row.score)
        got[row.query_id].append(row.vec_id)
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 2000, 50):
        sims = np.round(unit @ unit[q], 12)
        sims[q] = -9
        hits += len(set(got[q]) & set(np.lexsort((np.arange(2000), -sims))[:5].tolist()))
    assert hits >= 0.95 * 200
    assert got[50] == [0, 5, 10, 15, 20]


# ---- personal data


def test_permutation():
    for size in (1, 2, 10, 97, 1000):
        assert sorted(pii.permute(i, size, b"k", "t") for i in range(size)) == list(range(size))


def test_formats(spark, edge, none):
    key = b"k"
    text = "card 4111 1111 1111 1111, mail Ann.Lee7@mail.example.org, +1 (017) 555-7713, 10.0.0.255, 2024-02-29, 999.1.1.1, 2024-02-31, GB82 WEST 1234 5698 7654 32, 078-05-1120"
    out, spans = pii.pseudonymise(text, key)
    assert [s[0] for s in spans] == ["card", "email", "phone", "ip", "date", "iban", "ssn"]
    assert "999.1.1.1" in out and "2024-02-31" in out and len({s[3] for s in spans} & {s[4] for s in spans}) == 0
    card = "".join(c for c in spans[0][4] if c.isdigit())
    assert pii.luhn_digit(card[:-1]) == card[-1]
    iban = next(s[4] for s in spans if s[0] == "iban").replace(" ", "")
    assert pii._mod97(iban[4:] + iban[:4]) == 1
    assert pii.pseudonymise("4111111111111111", key)[0] == card  # linked across documents and spellings
    for text in ("order 1700000000000", "at 20240131123456", "4111 1111 1111 1112"):  # not valid as cards
        assert pii.pseudonymise(text, key) == (text, [])
    same = ["415-555-1234", "+1 415-555-1234", "(415) 555-1234", "+1 415.555.1234"]
    assert len({"".join(c for c in pii.pseudonymise(t, key)[0] if c.isdigit())[-10:] for t in same}) == 1
    assert pii.pseudonymise("on 03/25/2024", key)[1][0][0] == "date" and pii.pseudonymise("2001:db8:0:0:0:0:0:1", key)[1][0][0] == "ip"
    cards = [p + pii.luhn_digit(p) for p in (f"{i:015d}" for i in range(4 * 10**14, 4 * 10**14 + 200))]
    assert len({pii.pseudonymise(c, key)[0] for c in cards}) == 200  # a permutation: no two alike
    assert pii.pseudonymise("nothing here", key) == ("nothing here", [])
    rows = {r.doc_id: r for r in pii.pseudonymise_documents(edge, key).collect()}
    assert rows[1].text is None and rows[3].text == "!!! 123" and pii.pseudonymise_documents(none, key).count() == 0


# ---- pipeline


def test_pipeline(spark, edge, none):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == columns, name
        docs = out
    empty = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0
    lang = corpus_pipeline.language(spark, spark.read.parquet(f"{SMALL}/documents.parquet"), SMALL)
    assert lang.count() >= 0.99 * spark.read.parquet(f"{SMALL}/documents.parquet").count()


def test_pipeline_predicts_once(spark):
    """The filter on the prediction does not have it computed again."""
    import corpus_pipeline

    plan = corpus_pipeline.language(spark, spark.read.parquet(f"{SMALL}/documents.parquet"), SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_pipeline_edges(spark):
    """Nulls, empty, letterless and noise texts, repeated rows and ids, and columns called as those used inside."""
    import corpus_pipeline

    base = spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) > 200").orderBy("doc_id").limit(60)
    first = base.first()
    r = random.Random(1)
    odd = [(900, None, None, None, None), (901, "", "en", "a", 0), (902, "!!! 123", "en", "a", 7), (903, "".join(r.choice("qxzjkvwpbg") for _ in range(200)), None, "a", 200), (904, first.text, "en", None, len(first.text)), (904, first.text, "en", None, len(first.text))]
    docs = base.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long"))
    docs = docs.select("*", *[(F.col("doc_id") + 0.5).alias(c) for c in ("score", "fit", "n_removed", "n_lines", "id", "version", "kept", "size")])
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name == "byte_bpe":
            break
        assert out.columns == columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert docs.where("score <> doc_id + 0.5 or fit <> doc_id + 0.5 or n_removed <> doc_id + 0.5 or n_lines <> doc_id + 0.5").count() == 0, name
        ids = [x.doc_id for x in docs.select("doc_id").collect()]
        assert not {900, 901, 902, 903} & set(ids) and ids, name
        if name == "line_dedup":
            assert 904 not in ids  # all its lines stand in an earlier document
    assert out.count() == docs.count()
