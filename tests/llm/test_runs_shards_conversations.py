"""Periodic runs, shards along a curve and conversation repair: against brute force, SQL and odd rows."""

import hashlib
import itertools
import random
import zlib
from heapq import heappop, heappush

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from trialspark.llm import common, conversations, runs, sharding
from trialspark.llm.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


def plain_runs(words, least=6, exponent=4):
    """(start, length, period) of all runs, from every stretch of equal words q apart."""
    n, out = len(words), set()
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            whole = words[i : j + q]
            if len(whole) >= max(least, exponent * q) and not any(all(a == b for a, b in zip(whole, whole[p:])) for p in range(1, q)):
                out.add((i, len(whole), q))
            i = max(j, i + 1)
    return sorted(out)


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic(rng, n, vocabulary):
    words = [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        a, p = rng.randrange(n), rng.randint(1, max(1, n // 5))
        for i in range(a, min(n, a + p * rng.randint(2, 9) + rng.randrange(p))):
            words[i] = words[a + (i - a) % p]
    return words


@pytest.mark.parametrize("open_", [False, True])
def test_fragments_of_tiles_against_plain_runs(open_):
    rng = random.Random(5)
    for _ in range(300):
        words = periodic(rng, rng.randint(1, 160), rng.choice([1, 2, 3, 40]))
        h = common.mixed(np.array([zlib.crc32(w.encode()) for w in words], np.uint64))
        if open_:
            parts = [runs.fragments(h[o:e], low, high, 4, o > 0, e < len(h)) + np.array([0, o, o]) for o, low, high, e in runs._slices(h, 32, 4)]
            found = np.concatenate(parts) if parts else np.empty((0, 3), int)
        else:
            found = runs.fragments(h, 0, runs._octaves(len(h), 4))
        out = []
        for q, start, end in sorted(found.tolist()):
            if out and out[-1][0] == q and start <= out[-1][2] - q:
                out[-1][2] = max(out[-1][2], end)
            else:
                out.append([q, start, end])
        assert sorted((s, e - s, q) for q, s, e in out if e - s >= max(6, 4 * q)) == plain_runs(words)


@pytest.mark.parametrize("long", [16, runs.LONG])
def test_runs_of_texts_tiled_in_one_task_and_dealt_as_slices(spark, long):
    rng = random.Random(9)
    texts = [" ".join(periodic(rng, rng.randint(1, 400), rng.choice([1, 2, 5, 99]))) for _ in range(60)]
    texts += [None, "", " \t ", "x", "a b " * 40, "a b " * 40, "é ü " * 12 + "é", "z " * 5, "z " * 6]
    rows = [(k if k % 11 else None, t, "clash", k) for k, t in enumerate(texts)] + [(1, texts[1], "clash", 1), (None, texts[0], "clash", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string, _runs int").repartition(3)
    got = sorted((r.doc_id is None, r.doc_id or 0, r._n_words, [tuple(x) for x in r.found], bytes(r._out)) for r in runs.with_runs(docs.drop("_runs"), long=long).withColumnRenamed("_runs", "found").collect())
    told = []
    for i, t, *_ in rows:
        words = brute.SPACE.findall(t or "")
        told.append((i is None, i or 0, len(words), plain_runs(words), collapsed(words, plain_runs(words)).encode()))
    assert got == sorted(told)
    out = runs.collapse_runs(docs, long=long)
    assert out.columns == docs.columns and {r._key for r in out.collect()} == {"clash"}
    kept = {(r._runs, r.text) for r in out.collect()}
    assert kept == {(k, collapsed(w, plain_runs(w)) if plain_runs(w) else t) for _, t, _, k in rows for w in [brute.SPACE.findall(t or "")]}


def test_op11_against_plain_python(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").collect()
    told = {}
    for d in docs:
        words = brute.SPACE.findall(d.text or "")
        h, n = zlib.crc32(str(d.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + i % p] for i in range(n - a)]
        found = plain_runs(words) if n < 3000 else None
        told[d.doc_id] = words, found
    assert sum(bool(f) for _, f in told.values()) > 5
    seen = 0
    for r in QUERIES["op11_periodic_runs"](spark, DIR).collect():
        words, found = told[r.doc_id]
        if found is None:
            continue
        seen += 1
        best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None, None, None)
        sha = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        exponent = 1000 * best[1] // best[2] if found else None
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256) == (len(found), *best, exponent, sha)
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, found).encode()).hexdigest()
    assert seen > 100


@pytest.mark.parametrize("name", ["op12_hilbert_shards", "op13_conversation_repair"])
def test_new_operators_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    told = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted((tuple(str(r[c]) for c in columns) for r in df.collect())) == sorted(tuple(str(v) for v in r) for r in told)


@pytest.mark.parametrize(("n", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_the_curve_takes_single_steps_through_all_cells(spark, n, bits):
    cells = spark.createDataFrame([(list(c),) for c in itertools.product(range(1 << bits), repeat=n)], "c array<int>")
    rows = sorted((r.p, r.c) for r in cells.select("c", sharding.hilbert_index([F.col("c")[i] for i in range(n)], bits).alias("p")).collect())
    assert [p for p, _ in rows] == list(range(1 << n * bits))
    assert all(sum(abs(a - b) for a, b in zip(x, y)) == 1 for (_, x), (_, y) in zip(rows, rows[1:]))


def odd_documents(spark, n=120):
    rng = random.Random(3)
    rows = [(k if k % 9 else None, rng.choice([None, "", "same text", f"text {k} " * rng.randint(1, 9), "ü" * 300]), rng.choice(["en", "de", None]), rng.choice(["hot", "hot", f"s{k}", None]), k, "x") for k in range(n)]
    return spark.createDataFrame(rows + rows[:7], "doc_id long, text string, lang string, source string, _place int, shard string").repartition(4)


@pytest.mark.parametrize("shards", [1, 3, 16, 1000])
def test_shards_are_gapless_and_at_most_one_apart(spark, shards):
    docs = odd_documents(spark)
    rows = sharding.shard_plan(docs, shards=shards).collect()
    assert len(rows) == 127
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    texts = sorted((d.doc_id is None, d.doc_id or 0, len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode())) for d in docs.collect())
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.text_crc32) for r in rows) == texts
    sizes = [len(by.get(k, [])) for k in range(shards)]
    assert sum(sizes) == 127 and max(sizes) - min(sizes) <= 1 and max(by) < shards


def test_written_shards_hold_all_rows_in_order_and_can_be_skipped(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").withColumn("row", F.lit("clash"))
    sharding.write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, back.select(docs.columns).collect())) == sorted(map(str, docs.collect()))
    bounds = sharding.shard_bounds(sharding.shard_plan(docs)).collect()
    lang = docs.filter("lang IS NOT NULL").first().lang
    assert sum(b.least_lang <= lang <= b.greatest_lang for b in bounds if b.least_lang) < 12
    assert sum(b.least_size <= 100 <= b.greatest_size for b in bounds) < 12


def test_a_dimension_of_few_values_and_of_nulls_only(spark):
    rows = spark.createDataFrame([(k, f"t{k}", None, "one") for k in range(20)], "doc_id long, text string, lang string, source string")
    assert sorted(r.shard for r in sharding.shard_plan(rows, shards=5).collect()) == [k for k in range(5) for _ in range(4)]
    assert sharding.cell_bounds(spark.createDataFrame([(3,), (3,), (None,), (9,)], "v int"), "v", 2) == [(3, 0), (9, 2), (None, 3)]


def plain_audit(rows):
    """(cost, least letters, repaired lines) of rows (role, text) by a search over all edits in order of cost, then letters."""
    seen, kinds = set(), []
    for role, text in rows:
        blank = not brute.SPACE.search(text)
        gone = blank or (role, text) in seen
        seen.add((role, text))
        kinds.append((gone, not blank and not gone and text.strip(" \t\n\r\x0b\x0c")[-1] not in ".!?"))
    heap = [(0, "", 0, "", ())]  # cost, letters, row, initials, lines
    best = {}
    while heap:
        cost, letters, i, initials, lines = heappop(heap)
        body = initials.removeprefix("s")
        if body != ("ua" * len(body))[: len(body)] or best.setdefault((i, initials), (cost, letters)) < (cost, letters) or len(initials) > 2 * len(rows) + 2:
            continue
        if i == len(rows) and initials != "s" and len(body) % 2 == 0:
            return cost, letters, lines
        for role in ("user", "assistant"):
            heappush(heap, (cost + 2, letters + "I", i, initials + role[0], (*lines, f"{role}:")))
        if i < len(rows):
            (role, text), (gone, cut) = rows[i], kinds[i]
            heappush(heap, (cost + 3, letters + "D", i + 1, initials, lines))
            if not gone:
                heappush(heap, (cost + cut, letters + "K", i + 1, initials + (role[:1] or "?"), (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    heappush(heap, (cost + cut + 2, letters + "R", i + 1, initials + new[0], (*lines, f"{new}:{text}")))


@pytest.mark.parametrize("block", [1, 2, 5, conversations.BLOCK])
def test_repairs_against_a_search_over_all_edits(spark, block):
    rng = random.Random(block)
    data, told = [], {}
    for c in range(40):
        turns = sorted(rng.choices([None, *range(9)], k=rng.randint(1, 8)), key=lambda t: -1 if t is None else t)
        rows = [(t, rng.choice(["user", "user", "assistant", "system", "tool", ""]), rng.choice(["a.", "b", "c!", " ", "", "d? \n", f"{rng.random()}."])) for t in turns]
        data += [(c if c else None, t, r, x, "clash") for t, r, x in rows]
        rows.sort(key=lambda r: (-1 if r[0] is None else r[0], r[1], hashlib.md5(r[2].encode()).hexdigest()))
        told[c if c else None] = plain_audit([r[1:] for r in rows])
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, _key string").repartition(3)
    got = {r.conv_id: (r.cost, r.audit, r.repaired_sha256) for r in conversations.audits(df, block=block).collect()}
    assert got == {k: (cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest()) for k, (cost, letters, lines) in told.items()}
    by = {}
    for r in conversations.repair_conversations(df, block=block).collect():
        by.setdefault(r.conv_id, []).append((r.n, f"{r.role}:{r.text}"))
    assert {k: tuple(x for _, x in sorted(v)) for k, v in by.items()} == {k: lines for k, (*_, lines) in told.items() if lines}


def test_faults_gaps_and_pairs_are_counted(spark):
    rows = [(1, 0, "user", "one."), (1, 0, "user", "one."), (1, 4, "user", " \n"), (1, 5, "system", "cut"), (1, None, "assistant", "x."), (2, None, "user", "a."), (3, 1, None, None)]
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal) for r in conversations.audits(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert out == {1: (3, 1, 1, 1, 3), 2: (0, 0, 0, 0, 0), 3: (0, 1, 0, 0, 0)}


def test_a_conversation_whose_rows_all_go_and_null_ids(spark, tmp_path):
    gone = next(k for k in range(999) if zlib.crc32(f"{k}:1".encode()) % 20 == 0)
    rows = [(gone, 1, "user", "hi."), (None, None, None, None), (None, 3, "assistant", "yes.")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    out = QUERIES["op13_conversation_repair"](spark, str(tmp_path))
    told = con.execute(f"SELECT {', '.join(out.columns)} FROM ({ORACLES['op13_conversation_repair']})").fetchall()
    assert sorted(map(str, told)) == sorted(str(tuple(r)) for r in out.collect())
    assert next(tuple(r) for r in out.collect() if r.conv_id == gone) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_checkpoints_do_not_change_the_walk():
    rng = random.Random(1)
    for n in (1, 2, 17, 300):
        codes = [rng.randrange(9) for _ in range(n)]
        end = conversations.END
        vectors = [end]
        for c in reversed(codes):
            vectors.append(conversations._before(c, vectors[-1]))
        letters, state = conversations.walk(codes)
        cost, at = 0, 0
        for x, c in zip(letters, codes, strict=True):
            for y in x:
                cost += {"D": 3, "I": 2, "K": 0, "R": 2}[y] + ((c - 1) % 2 if y in "KR" else 0)
                at = conversations.after_edit(y, c, at)
        assert (at, cost + 2 * len(conversations.last_inserts(state))) == (state, vectors[-1][0])
