"""The methods themselves: against brute force, exact round trips, and properties."""

import gzip
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from trialspark.llm import common, components, decontaminate, fingerprint, jaccard, language, licenses, mixing, substring, tokens, toxicity, warc


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def test_words_match_the_regular_expressions():
    texts = ["", " a\tb\nc ", "ÄÖ x9-y ABC", "no", "\x0b\x0c", None, "é" * 5, "a  b"]
    for table, lower, pattern in ((common.NOT_SPACE, False, brute.SPACE), (common.ALNUM, True, brute.ALNUM)):
        for size in (1, 6, 1 << 20):
            out = []
            for _, w in common.words_of(pa.array(texts), table, lower, size):
                out += [[w.data[w.start[i] : w.end[i]].tobytes().decode() for i in range(a, b)] for a, b in zip(w.at[:-1], w.at[1:], strict=True)]
            assert out == [pattern.findall((t or "").translate(brute.LOWER) if lower else (t or "")) for t in texts]


def test_equal_words_and_windows_have_equal_hashes_wherever_they_stand():
    _, w = next(common.words_of(pa.array(["b a b a c", "a b a"])))
    assert len(set(w.hash)) == 3 and w.hash[1] == w.hash[3] == w.hash[5] == w.hash[7]
    h = common.windows(w.hash, 3)
    assert h[1] == h[5] and h[0] != h[1]


@pytest.mark.parametrize("window", [2, 3, 5, 12])
def test_substrings_against_brute_force(spark, window):
    rng = random.Random(window)
    passage = words(rng, 30)
    texts = []
    for k in range(60):
        t = words(rng, rng.randrange(0, 60), 60 if window < 5 else 400)
        if k % 3 == 0:
            a = rng.randrange(25)
            t[5:5] = passage[a : a + rng.randrange(1, 30)]
        texts.append(" ".join(t))
    texts += [texts[3], texts[4] + " x", "z " * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = substring.factored(docs, window).withColumn("h", F.sha2("_kept", 256)).orderBy("doc_id").collect()
    assert [(r._n_words, r._n_removed, r.h) for r in out] == brute.repeats(texts, window)


def test_similar_groups_against_brute_force(spark):
    rng = random.Random(4)
    base = [words(rng, 60) for _ in range(6)]
    shared = words(rng, 25)
    docs = []
    for k in range(150):
        t = list(base[k % 6]) if k % 2 else words(rng, rng.randrange(1, 70))
        for _ in range(rng.randrange(0, 4)):
            t[rng.randrange(len(t))] = f"e{rng.randrange(10**6)}"
        if k % 5 == 0:
            t += shared
        docs.append((k, " ".join(t)))
    out = jaccard.similar_groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    assert {r.key: (r.n_shingles, r.component) for r in out.collect()} == brute.groups(docs)


def test_join_by_text_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SETS_BROADCAST", 0)
    rng = random.Random(5)
    base = words(rng, 80)
    docs = [(k, " ".join([*base[: 80 - k], *words(rng, k)])) for k in range(12)]
    out = jaccard.similar_groups(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.key: r.component for r in out.collect()} == {k: v[1] for k, v in brute.groups(docs).items()}


def test_rows_without_an_id_or_of_one_id_stand_for_themselves(spark):
    rng = random.Random(6)
    texts = [" ".join(words(rng, 60)) for _ in range(7)]
    rows = [(None, t) for t in texts[:3]] + [(None, texts[0] + " tail"), (5, texts[3]), (5, texts[4]), (7, texts[5]), (8, texts[5] + " tail"), (8, texts[6]), (None, ""), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = [(r.doc_id, r.text) for r in jaccard.one_of_each_group(docs).collect()]
    pair = [r for r in left if r in (rows[0], rows[3])]
    assert len(pair) == 1 and sorted(map(str, left)) == sorted(map(str, pair + rows[1:3] + rows[4:7] + rows[8:]))
    items = spark.createDataFrame([(1, texts[1]), (2, texts[4])], "item_id long, text string")
    kept = [(r.doc_id, r.text) for r in decontaminate.without_leaks(docs, items).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [r for r in rows if r[1] not in (texts[1], texts[4])]))


def test_suffix_filter_never_loses_a_pair():
    rng = np.random.default_rng(1)
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 60, dtype=np.uint64) * np.uint64(2)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 60))) for _ in range(2))
        assert jaccard._can_share(jaccard._part_counts(a), jaccard._part_counts(b)) >= len(np.intersect1d(a, b))


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (200, 201), (201, 202), (202, 200), (201, 200)]
    out = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[k] == 0 for k in range(41)) and all(out[k] == 100 for k in range(100, 130)) and {out[k] for k in (200, 201, 202)} == {200}


def test_signatures_estimate_generalised_jaccard(spark):
    rng = random.Random(8)
    texts = []
    for k in range(60):
        a = words(rng, 80, 60)
        texts += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(a[: 10 + k] + words(rng, 70 - k, 60)))]
    df = spark.createDataFrame(texts, "k long, text string")
    sig = {r.k: r.signature for r in fingerprint.signatures(df, ["k"], slots=96).collect()}
    gaps = []
    for k in range(60):
        a, b = (Counter(texts[2 * k + j][1].split()) for j in (0, 1))
        gaps.append(sum(x == y for x, y in zip(sig[2 * k], sig[2 * k + 1], strict=True)) / 96 - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(gaps)) < 0.02 and np.abs(gaps).max() < 0.2


def test_following_wraps_around(spark):
    out = {r._key: r._next for r in fingerprint.following(spark.createDataFrame([(k,) for k in (5, 1, 9, 30, 9)], "_key long")).collect()}
    assert out == {30: 9, 9: 5, 5: 1, 1: 30}


def test_targets_share_the_excess_again(spark):
    df = spark.createDataFrame([(0, 1, 10), (1, 2, 1000), (2, 3, 20), (3, 1, 0)], "_order int, weight int, source_size long")
    out = {r._order: r.target for r in mixing.targets(df).collect()}
    assert out == {0: 30.0, 1: 940.0, 2: 60.0, 3: 0.0}
    assert sum(out.values()) == 1030


def test_mixing_does_not_depend_on_buckets(spark):
    docs = spark.createDataFrame([(k, "x " * (k % 17), f"s{k % 3 if k % 2 else 0}") for k in range(300)], "doc_id long, text string, source string")
    runs = [sorted(mixing.mix_plan(docs, buckets=b).collect()) for b in (1, 7, 64)]
    assert runs[0] == runs[1] == runs[2]


def test_templates_take_optional_and_replaceable_regions():
    a = licenses.Automaton("licensed under [[a]] cc by {{version:1-2}} [[international]] license")
    assert a.matches("licensed under cc by 4 license".split()) == 6
    assert a.matches("licensed under a cc by 4 0 international license and more".split()) == 9
    assert a.matches("licensed under cc by license".split()) == 0
    assert a.matches("licensed under the cc by 4 license".split()) == 0
    with pytest.raises(ValueError):
        licenses.Automaton("[[optional]] start")


def test_salvage_recovers_what_is_after_damage(spark, tmp_path):
    pages = spark.createDataFrame([(k, "http://x", f"<p>{k} WARC/1.0\r\n {'y' * k}</p>") for k in range(30)], "page_id long, url string, html string")
    warc.write_warc(pages.coalesce(1), str(tmp_path / "w"))
    data = next((tmp_path / "w").glob("part-*")).read_bytes()
    whole = list(warc.salvage(data))
    assert len(whole) == 30 and all(r[4] is None for r in whole) and whole[0][0] == 0 and whole[-1][1] == len(data)
    start, end = whole[10][:2]
    for damaged in (data[: start + 200] + data[end - 3 :], data[:start] + b"\0" * (end - start) + data[end:], data[: end - 20] + b"#" + data[end - 19 :]):
        found = list(warc.salvage(damaged))
        good = [r[2]["warc-record-id"] for r in found if r[2]]
        assert good == [r[2]["warc-record-id"] for i, r in enumerate(whole) if i != 10]
        assert any(r[4] for r in found) and sum(b - a for a, b, *_ in found) == len(damaged)
    members = [gzip.compress(data[a:b]) for a, b, *_ in whole]
    broken = b"".join(m if i != 4 else m[:50] + b"\xff" * 9 + m[59:] for i, m in enumerate(members))
    found = list(warc.salvage(broken))
    assert sum(r[2] is not None for r in found) == 29 and any(r[4] for r in found)


def test_read_warc_logs_gaps(spark, tmp_path):
    pages = spark.createDataFrame([(k, "http://x", "z" * 150 + str(k)) for k in range(5)], "page_id long, url string, html string")
    warc.write_warc(pages.coalesce(1), str(tmp_path / "w"))
    data = next((tmp_path / "w").glob("part-*")).read_bytes()
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.warc").write_bytes(b"junk" + data)
    rows = warc.read_warc(spark, str(tmp_path / "d")).orderBy("start").collect()
    assert [(r.start, r.end, r.quarantined) for r in rows if r.quarantined] == [(0, 4, "no version line")]
    assert sorted(r.payload.decode() for r in rows if not r.quarantined) == sorted("z" * 150 + str(k) for k in range(5))


def test_restores_disguised_words():
    counts = np.zeros(toxicity.SYMBOLS**3)
    for batch in toxicity._trigrams([pa.RecordBatch.from_arrays([pa.array(["the idiot and moron are worthless pathetic losers " * 50])], ["t"])]):
        counts += batch.column(0)[0].values.to_numpy()
    r = toxicity.Restorer(counts)
    text = "the 1d10t, an i d i o t; m0r0n iiidiot\nhello"
    data = np.frombuffer(text.encode(), np.uint8)
    out, _ = toxicity._restored(data, np.array([0, len(data)]), r)
    assert out.tobytes().decode() == "the idiot an idiot; moron idiot\nhello"
    assert r.word("worthl3$$") == "worthless"


def test_restores_separators_spaced_signs_and_signs_at_the_end():
    counts = np.zeros(toxicity.SYMBOLS**3)
    plain = "the idiot and a moron are worthless pathetic losers an ass stupid well known end of it "
    for batch in toxicity._trigrams([pa.RecordBatch.from_arrays([pa.array([plain * 50])], ["t"])]):
        counts += batch.column(0)[0].values.to_numpy()
    r = toxicity.Restorer(counts)

    def restored(*texts):
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        out, offsets = toxicity._restored(data, np.r_[0, np.cumsum([len(t.encode()) for t in texts])], r)
        return [out.tobytes()[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]

    assert restored("an id.iot, st-upid mo_ron", "1 d 1 0 t", "i d i 0 t the a55 and a s s", "idi07") == ["an idiot stupid moron", "idiot", "idiot the ass and ass", "idiot"]
    assert restored("well-known", "the end.of it", "idiot!", "1 2 3 4", "1 0 1") == ["well-known", "the end.of it", "idiot!", "1 2 3 4", "1 0 1"]


def test_toxic_words_are_learned_whole_disguised_and_by_beginning(spark):
    rng = random.Random(2)
    rows = []
    for k in range(600):
        toxic = k % 4 == 0
        t = words(rng, 30)
        if toxic:
            t[7] = ["idiot", "1d10t", f"lostra{rng.randrange(99)}q"][k // 4 % 3]
        rows.append((k, " ".join(t), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"), df)
    out = df.join(toxicity.score(df, model), "doc_id").filter(toxicity.held_out()).collect()
    assert sum((r._score >= 0.7) == bool(r.toxic) for r in out) >= 0.97 * len(out)


def test_decontamination_against_plain_bm25(spark):
    rng = random.Random(3)
    items = [(k, " ".join(words(rng, rng.randrange(20, 150), 900))) for k in range(30)]
    docs = []
    for k in range(80):
        t = words(rng, rng.randrange(0, 400), 900)
        if k % 4 == 0:
            t[len(t) // 3 : len(t) // 3] = items[k % 30][1].upper().split()
        docs.append((k, ", ".join(t)))
    told = {(k, k % 30) for k in range(0, 80, 4)}
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 300):
        assert {(r.key, r.item) for r in decontaminate.leaks(docs, items, index_words=size).collect()} == told


def test_items_without_an_id_of_one_id_and_of_few_words_are_found(spark):
    rng = random.Random(8)
    texts = [" ".join(words(rng, 30)) for _ in range(4)]
    items = [(None, texts[0]), (7, texts[1]), (7, texts[2]), (8, "Alpha, beta? gamma"), (None, "solo"), (9, "beta alpha"), (3, "...")]
    docs = [(k, f"start {t} end") for k, t in enumerate(texts)] + [(4, "x alpha beta GAMMA"), (5, "alpha beta x gamma"), (6, "a solo b"), (7, "alpha beta"), (8, "gamma")]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 20):
        found = {(r.key, r.item) for r in decontaminate.leaks(docs.coalesce(1), items, index_words=size).collect()}
        assert found == {(0, None), (1, 7), (2, 7), (4, 8), (6, None)}
    assert {r.doc_id for r in decontaminate.without_leaks(docs, items).collect()} == {3, 5, 7, 8}


def test_block_bounds_retrieve_all_above_the_threshold():
    rng = np.random.default_rng(4)
    pieces = [rng.integers(0, 200, rng.integers(5, 40)).astype(np.int64) for _ in range(50)]
    df = Counter(int(t) for p in pieces for t in set(p.tolist()))
    index = decontaminate.Index(np.arange(50), pieces, df, 50, np.mean([len(p) for p in pieces]))
    impact = np.zeros((50, len(index.terms)))
    for t in range(len(index.terms)):
        impact[index.piece[index.first[t] : index.stop[t]], t] = index.impact[index.first[t] : index.stop[t]]
    has = rng.random((20, len(index.terms))) < 0.4
    passage, term = np.nonzero(has)
    found = {(p, i): s for p, i, s in index.retrieve(passage, term, 0.45)}
    plain = has @ impact.T
    assert set(found) == set(zip(*np.nonzero(plain >= 0.45), strict=True))
    assert all(math.isclose(s, plain[k], abs_tol=1e-5) for k, s in found.items())


@pytest.mark.parametrize("rule", tokens.RULES)
def test_boundary_tokens(rule):
    counts, crossing = tokens.allocated(np.array([2, 4, 2]), np.array([0, 3, 7]), rule)
    told = {"most": [1, 2, 0], "start": [2, 1, 0], "end": [1, 1, 1], "split": [1 + 1 / 4, 3 / 4 + 1 / 2, 1 / 2]}
    assert list(counts) == pytest.approx(told[rule]) and list(crossing) == [1, 2, 1]


def test_token_spans_round_trip(spark):
    encoder = tokens.load_encoder()
    for text in ("plain words, here", "ünï ☃ \n\n tabs\t", "a" * 1000, ""):
        assert encoder.lengths(text).sum() == len(text.encode())
    rows = spark.createDataFrame([(1, "a title here", "a\nbody of it"), (2, None, "x")], "id int, title string, body string")
    out = {r.id: r for r in tokens.count_by_field(rows, ["title", "body"]).collect()}
    assert out[1].n_tokens_title + out[1].n_tokens_body == len(encoder.lengths("a title here\na body of it"))
    assert out[2].n_tokens_body == 1


def test_languages_apart_within_and_between_families(spark):
    rng = random.Random(1)
    sounds = {"en": ["the", "ing", "sh", "wh"], "de": ["der", "ung", "sch", "tz"], "fr": ["eau", "oi", "ç", "que"], "es": ["ción", "ñ", "rr", "os"]}
    rows = [(k, " ".join("".join(rng.choices(s, k=3)) for _ in range(20)), lang) for k, (lang, s) in enumerate(list(sounds.items()) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs.filter(~language.held_out()))
    out = language.by_language(docs, model, ("doc_id", "lang")).filter(language.held_out()).collect()
    assert len(out) > 20 and all(r.lang == r._lang and 0.5 < r._score <= 1 for r in out)
