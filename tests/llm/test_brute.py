"""Operators that SQL can't express, against plain Python over small fixtures."""

import gzip
import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
import xxhash

from tests.llm import brute
from trialspark.llm import decontaminate, fingerprint, language, licenses, mixing, substring, tokens, toxicity, warc


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# op2: templates


def matches_by_search(markup, text):
    """Whether a template matches at the text's start, and with how few words: all ways through the markup, tried."""
    parts = re.findall(r"\[\[|\]\]|\{\{\w+:\d+-\d+\}\}|[0-9a-z]+", markup)

    def expand(parts):
        if not parts:
            return [[]]
        if parts[0] == "[[":
            depth, k = 1, 1
            while depth:
                depth += {"[[": 1, "]]": -1}.get(parts[k], 0)
                k += 1
            return expand(parts[k:]) + [a + b for a in expand(parts[1 : k - 1]) for b in expand(parts[k:])]
        if parts[0].startswith("{{"):
            low, high = map(int, re.findall(r"\d+", parts[0])[-2:])
            return [[None] * n + rest for n in range(low, high + 1) for rest in expand(parts[1:])]
        return [[parts[0], *rest] for rest in expand(parts[1:])]

    found = [len(way) for way in expand(parts) if len(way) <= len(text) and all(a is None or a == b for a, b in zip(way, text, strict=False))]
    return min(found, default=0)


def test_automata_against_all_ways_through_the_markup():
    rng = random.Random(11)
    for label, templates in licenses.TEMPLATES.items():
        for markup in templates:
            automaton = licenses.Automaton(markup)
            own = re.findall(r"[0-9a-z]+", re.sub(r"\{\{.*?\}\}", "x y", markup))
            if markup.count("[[") > 6:
                continue
            for _ in range(60):
                text = [w for w in own if rng.random() < 0.97] + words(rng, 3)
                if rng.random() < 0.5:
                    text.insert(rng.randrange(len(text)), "odd")
                assert automaton.matches(text) == matches_by_search(markup, text), (label, text)


def test_whole_texts_and_leading_regions(spark):
    def written(markup, keep):
        """A text of the template: optional regions written or not, two words in each replaceable one."""
        while "[[" in markup:
            markup = re.sub(r"\[\[([^\[\]]*)\]\]", r"\1" if keep else "", markup)
        return re.sub(r"\{\{\w+:(\d+)-(\d+)\}\}", lambda m: " ".join(["X"] * min(int(m[2]), max(2, int(m[1])))), markup)

    texts = {f"{label} {keep}": written(t, keep).upper() for label, t in licenses.FULL.items() for keep in (True, False)}
    texts |= {f"{k} less": t.rsplit(" ", 1)[0] for k, t in texts.items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    for r in licenses.license_scan(docs).collect():
        label = r.doc_id.split()[0]
        assert (label in r.labels.split(",")) == (not r.doc_id.endswith("less")), r.doc_id
    leading = {"x": ["{{who:2-3}} [[may [[now]] freely]] copy this"]}
    docs = spark.createDataFrame([(1, "all of us copy this"), (2, "we copy this"), (3, "anyone at all may freely copy this"), (4, "copy this"), (5, "one two copy that")], "doc_id int, text string")
    assert {r.doc_id for r in licenses.license_scan(docs, {}, leading).filter("labels = 'x'").collect()} == {1, 3}


# op3: archives


def archive(spark, path, n=40):
    pages = spark.createDataFrame([(k, "http://x", f"<p>{k} {'y' * (100 + 3 * k)}</p>") for k in range(n)], "page_id long, url string, html string")
    warc.write_warc(pages.coalesce(1), str(path))
    return next(path.glob("part-*")).read_bytes()


def test_members_of_several_records_and_damaged_members(spark, tmp_path):
    data = archive(spark, tmp_path / "w")
    whole = [r for r in warc.salvage(data)]
    parts = [data[a:b] for a, b, *_ in whole]
    zipped = [gzip.compress(b"".join(parts[k : k + 5])) for k in range(0, 40, 5)]
    found = list(warc.salvage(b"".join(zipped)))
    assert [r[2]["warc-record-id"] for r in found if r[2]] == [r[2]["warc-record-id"] for r in whole]
    assert sum(b - a for a, b, *_ in found) == sum(map(len, zipped))
    bad = bytearray(b"".join(parts[5:10]))
    bad[len(parts[5]) + 300] ^= 1  # the second record's payload
    zipped[1] = gzip.compress(bytes(bad))
    found = list(warc.salvage(b"".join(zipped)))
    assert [r[2]["warc-record-id"] for r in found if r[2]] == [r[2]["warc-record-id"] for k, r in enumerate(whole) if k != 6]
    assert [r[4] for r in found if r[4]] and sum(b - a for a, b, *_ in found) == sum(map(len, zipped))
    stored = gzip.compress(b"".join(parts), 0)  # stored without compression, so that what stands before the cut can be read
    cut = stored[: len(stored) // 2]
    found = list(warc.salvage(cut + gzip.compress(parts[0])))
    assert len([r for r in found if r[2]]) > 10 and found[-1][2]["warc-record-id"] == whole[0][2]["warc-record-id"]
    assert sum(b - a for a, b, *_ in found) == len(cut) + len(gzip.compress(parts[0]))


def test_salvage_takes_time_in_proportion(spark, tmp_path):
    member = gzip.compress(archive(spark, tmp_path / "w", 5), 1)
    import time

    took = []
    for n in (2000, 8000):
        data = member * n
        began = time.perf_counter()
        assert sum(r[2] is not None for r in warc.salvage(data)) == 5 * n
        took.append(time.perf_counter() - began)
        data = (member[:40] + b"\xff" * 9 + member[49:]) * n  # all damaged
        began = time.perf_counter()
        assert all(r[2] is None for r in warc.salvage(data))
        took.append(time.perf_counter() - began)
    assert took[2] < 9 * took[0] + 1 and took[3] < 9 * took[1] + 1


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 8192)
    monkeypatch.setattr(warc, "SMALL_BYTES", 256)
    sizes = [10, 100, 256, 257, 1000, 4000, 4096, 5000, 20_000, 100_000, 0] * 6
    pages = spark.createDataFrame([(k, "u", chr(97 + k % 26) * n) for k, n in enumerate(sizes)], "page_id long, url string, html string")
    warc.write_warc(pages.coalesce(1), str(tmp_path / "w"))
    for f in (tmp_path / "w").glob("part-*"):
        payload = [len(r[3]) for r in warc.salvage(f.read_bytes())]
        assert len(payload) == 1 or sum(payload) <= 8192
    assert warc.read_warc(spark, str(tmp_path / "w")).count() == len(sizes)


def test_revisits_must_agree_with_their_response(spark, tmp_path):
    html = "z" * 200
    pages = spark.createDataFrame([(1, "u", html), (2, "u", html), (3, "u", "q" * 150), (4, "u", "q" * 150)], "page_id long, url string, html string")
    warc.write_warc(pages.coalesce(1), str(tmp_path / "w"))
    data = next((tmp_path / "w").glob("part-*")).read_bytes()
    digest = hashlib.sha256(b"q" * 150).hexdigest().encode()
    at = data.rindex(digest)
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.warc").write_bytes(data[:at] + b"0" * 64 + data[at + 64 :])
    rows = warc.checked_revisits(warc.read_warc(spark, str(tmp_path / "d"))).collect()
    assert sorted((r.record_id, r.quarantined) for r in rows if r.record_type == "revisit") == [("<urn:page:2>", None), ("<urn:page:4>", "revisit agrees with no response")]


# op4: lattices


def least_path(r, word):
    """The least costly reading by trying every path of the lattice, costs added up at the end of each."""
    solid = "".join(c for c in word if c.isalpha() or c in toxicity.RESEMBLES)
    last = max((k for k, c in enumerate(solid) if c.isalpha()), default=-1)
    choices, i = [], -1
    for c in word:
        sign, letter = c in toxicity.RESEMBLES, c.isalpha()
        i += sign or letter
        mine = [("put", c, 0.0)] if letter else [("put", c, toxicity._STAYS)]
        if sign:
            mine += [("put", x, toxicity._COST) for x in toxicity.RESEMBLES[c]]
        if not letter:
            mine.append(("drop", "", toxicity._DROPS_SIGN if sign else toxicity._DROPS))
            if not sign and 0 <= i < len(solid) - 1:
                mine.append(("edge", c, 0.0))
            elif sign and i > last and c not in toxicity._NO_END:
                mine.append(("edge", c, toxicity._COST))
        run = (sign or letter) and ((i >= 2 and solid[i - 2 : i + 1] == c * 3) or (0 < i < len(solid) - 1 and solid[i - 1 : i + 2] == c * 3))
        if letter and run:
            mine.append(("absorb", c, toxicity._ABSORBED))
        choices.append(mine)
    best = None
    for path in itertools.product(*choices):
        total, text, state = 0.0, "", (0, 0)
        for kind, x, cost in path:
            if kind == "put":
                s = ord(x) - 96 if "a" <= x <= "z" else 27
                total, text, state = total + cost + r.cost[state[0], state[1], s], text + x, (state[1], s)
            elif kind == "edge":
                total, text, state = total + (cost + r.cost[state[0], state[1], 0] if state[1] else 0.0), text + x, (0, 0)
            elif kind == "absorb" and not text.endswith(x):
                break
            else:
                total += cost
        else:
            total += r.cost[state[0], state[1], 0] if state[1] else 0.0
            if best is None or (total, text) < best:
                best = (total, text)
    return best


def test_viterbi_finds_the_least_path_of_all():
    counts = np.zeros(toxicity.SYMBOLS**3)
    for batch in toxicity._trigrams([pa.RecordBatch.from_arrays([pa.array(["the idiot and moron are so stupid an ass " * 30])], ["t"])]):
        counts += batch.column(0)[0].values.to_numpy()
    r = toxicity.Restorer(counts)
    rng = random.Random(4)
    for word in ["1d10t", "id.iot", "m0r-on", "st*p1d", "a55", "iiidi0t", "aa5s!", *("".join(rng.choices("idotmrn10$.-!", k=6)) for _ in range(60))]:
        told = least_path(r, word)
        assert r.word(word) == told[1], (word, told)


# op5: factors


@pytest.mark.parametrize("window", [3, 12])
def test_factors_lie_in_their_references_and_cover_all_repeats(spark, window):
    rng = random.Random(window)
    passage = words(rng, 40)
    texts = []
    for k in range(50):
        t = words(rng, rng.randrange(0, 60), 50 if window < 5 else 400)
        if k % 2:
            a = rng.randrange(20)
            t[5:5] = passage[a : a + rng.randrange(window, 30)]
        texts.append(" ".join(t))
    texts += [texts[1], texts[1] + " tail", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    split = [(t or "").split() for t in texts]
    covered = [set() for _ in texts]
    for f in substring.factors(docs, window).collect():
        assert f.n_words >= window and (f.doc_id, f.start) != (f.ref_doc_id, f.ref_start)
        assert split[f.doc_id][f.start : f.start + f.n_words] == split[f.ref_doc_id][f.ref_start : f.ref_start + f.n_words]
        covered[f.doc_id] |= set(range(f.start, f.start + f.n_words))
    for w, (n, removed, _), mine in zip(split, brute.repeats(texts, window), covered, strict=True):
        assert n == len(w) and len(mine) == removed


def test_greedy_factors_go_on_while_the_reference_does():
    place = lambda start, run=0: (start << substring.RUN) | run
    out = substring._greedy(np.array([place(7, 2), place(3, 3), place(20), place(21)]), np.array([9, 9, 5, 6]), np.array([place(17, 2), place(13, 3), place(0), place(1)]), 4)
    assert out.tolist() == [[3, 10, 9, 13], [20, 4, 5, 0], [21, 4, 6, 1]]


def test_rows_without_an_id_lose_their_own_repeats(spark):
    rng = random.Random(6)
    a, b, c = (" ".join(words(rng, 60)) for _ in range(3))
    rows = [(None, a), (None, b), (None, a + " " + c), (1, c), (1, b), (1, "short")]
    out = substring.factored(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 35, ("doc_id", "text"))
    told = {t: x for (_, t), x in zip(rows, brute.repeats([t for _, t in rows], 35), strict=True)}
    for r in out.collect():
        assert (r._n_words, r._n_removed, hashlib.sha256(bytes(r._kept)).hexdigest()) == told[r.text]


@pytest.mark.parametrize("second", [41, 120])
def test_rows_of_one_id_are_told_apart_by_more_than_a_few_bits(spark, second):
    """Two texts of no id whose hashes agree in their last 27 bits, one of them repeated elsewhere."""
    rng, bits, seen, pair = random.Random(second), (1 << 27) - 1, {}, None
    while pair is None:
        text, other = (" ".join(words(rng, n, 10_000)) for n in (120, second))
        seen[xxhash.xxh64_intdigest(text, 42) & bits] = text
        if (match := seen.get(xxhash.xxh64_intdigest(other, 42) & bits)) and match != other:
            pair = match, other
    rows = [(None, pair[0]), (None, pair[1]), (7, pair[0] + " and more")]
    out = substring.factored(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), 35, ("text",)).collect()
    told = {t: n for (_, t), (_, n, _) in zip(rows, brute.repeats([t for _, t in rows], 35), strict=True)}
    assert {r.text: r._n_removed for r in out} == told and told[pair[1]] == 0


def test_the_mix_takes_equal_rows_once_each(spark):
    rows = [(None, "a b c d " * 10, "s", k) for k in range(5)] + [(1, "x " * 20, "s", 9), (1, "x " * 20, "t", 9), (2, "y " * 30, "t", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(3)
    out = mixing.mix_documents(docs).collect()
    plan = mixing.mix_plan(docs).collect()
    assert sum(r.taken for r in out) == sum(r.taken for r in plan) and sorted(r.taken for r in out) == sorted(r.taken for r in plan if r.taken)
    assert len({(r.doc_id, r.source, r.n) for r in out}) == len(out) and all(r.taken <= 3 * r["size"] for r in out)
    two = spark.createDataFrame(rows[:1] * 2, docs.schema)
    assert [r.taken for r in mixing.mix_documents(two).collect()] == [40, 40]


# op7: fingerprints


def samples(text, slots):
    """For each slot the sampled (word, t), by the method in plain Python."""
    counts, out = Counter(w for w in re.split(r"[\x20\x09-\x0D]+", text) if w), []
    for slot in range(slots):
        best = None
        for w, n in counts.items():
            term = xxhash.xxh64_intdigest(w.encode(), 42)
            draws = []
            for k in range(3):
                first = xxhash.xxh64_intdigest(term.to_bytes(8, "little"), 42)
                draws.append(xxhash.xxh64_intdigest((3 * slot + k + 1000 * fingerprint.SEED).to_bytes(4, "little"), first))
            unit = lambda bits: (bits + 1) / ((1 << 32) + 1)
            high, low = [unit(d >> 32) for d in draws], [unit(d & 0xFFFFFFFF) for d in draws]
            r, c = -math.log(high[0] * low[0]), -math.log(high[1] * low[1])
            t = math.floor(math.log(n) / r + high[2]) if n > 1 else 0
            score = (math.log(c) - r * (t - high[2] + 1), w, t)
            best = score if best is None or score < best else best
        out.append(best and best[1:])
    return out


def test_fingerprints_against_plain_python(spark, tmp_path):
    rng = random.Random(7)
    texts = {k: " ".join(words(rng, rng.randrange(0, 40), 30)) + ("é ☃" if k % 3 else "") for k in range(25)} | {30: "", 31: "one", 32: "one one\ttwo"}
    spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    order = sorted(texts, reverse=True)
    following = dict(zip(order, order[1:] + order[:1], strict=True))
    for r in fingerprint.op7_fingerprints(spark, str(tmp_path)).collect():
        mine, other = texts[r.doc_id], texts[following[r.doc_id]]
        cut = len(mine) // 3
        edited = mine[: len(mine) - cut] + other[:cut]
        assert (r.n_chars, r.edited_sha256) == (len(mine), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = (samples(t, fingerprint.SLOTS) for t in (mine, edited, other))
        like = lambda x, y: 1.0 if x[0] == y[0] is None else 0.0 if None in (x[0], y[0]) else sum(p == q for p, q in zip(x, y, strict=True)) / len(x)
        assert (r.near_edited, r.near_next) == pytest.approx((like(a, b), like(a, c)))
        assert (r.fingerprint == r.edited_fingerprint) == (a == b)


def test_fingerprints_of_repeated_and_missing_ids(spark, tmp_path):
    rows = [(None, f"text {k % 4} of none") for k in range(12)] + [(5, "a b c"), (5, "a b c"), (5, "d e f"), (7, "x y z")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = fingerprint.op7_fingerprints(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.n_chars) for r in out) == Counter((k, len(t)) for k, t in rows)
    assert len({r.fingerprint for r in out}) == 4 + 2 + 1
    assert len({(r.doc_id, r.fingerprint, r.edited_fingerprint, r.near_next) for r in out}) == 4 + 2 + 1


# op8: retrieval and overlaps


def test_leaks_against_plain_bm25(spark):
    rng = random.Random(9)
    items = [(k % 7 if k % 5 else None, " ".join(words(rng, rng.randrange(1, 160), 500))) for k in range(30)]
    docs = []
    for k in range(60):
        t = words(rng, rng.randrange(0, 300), 500)
        source = items[k % 30][1].split()
        part = source[: max(1, len(source) * (5 + k % 6) // 10)]
        t[len(t) // 2 : len(t) // 2] = part
        docs.append((k, " ".join(t)))
    pieces = [(i, w[a : a + decontaminate.PIECE]) for i, (_, t) in enumerate(items) for w in [t.split()] if len(w) >= decontaminate.LEAST_WORDS for a in range(0, len(w), decontaminate.PIECE)]
    df, mean = Counter(w for _, p in pieces for w in set(p)), sum(len(p) for _, p in pieces) / len(pieces)
    impact = []
    for i, p in pieces:
        weights = {w: math.log1p((len(pieces) - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(p) / mean)) for w, n in Counter(p).items()}
        impact.append((i, {w: x / sum(weights.values()) for w, x in weights.items()}))
    grams = lambda w, n: {tuple(w[a : a + n]) for a in range(len(w) - n + 1)}
    told = set()
    for k, text in docs:
        w = text.split()
        for i, (item, t) in enumerate(items):
            mine = t.split()
            if len(mine) < decontaminate.LEAST_WORDS:
                if tuple(mine) in grams(w, len(mine)):
                    told.add((k, item))
                continue
            passages = [set(w[a : a + 2 * decontaminate.PIECE]) for a in range(0, max(1, len(w)), decontaminate.PIECE)]
            best = max(sum(x for term, x in weights.items() if term in p) for j, weights in impact if j == i for p in passages)
            mine_grams = grams(mine, 5)
            if best >= decontaminate.THRESHOLD and len(mine_grams & grams(w, 5)) / len(mine_grams) >= decontaminate.OVERLAP:
                told.add((k, item))
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 400):
        assert {(r.key, r.item) for r in decontaminate.leaks(docs, items, index_words=size).collect()} == told


# op9: attribution


@pytest.mark.parametrize("rule", tokens.RULES)
def test_sections_against_plain_encoding(spark, rule):
    encoder = tokens.load_encoder()
    encoder.lengths("a")
    encoding: tiktoken.Encoding = encoder._encoding
    rng = random.Random(3)
    texts = ["", "\n", "a\n\n\nb", "über  \n ☃☃\nlast line", "x" * 500 + "\n" + " y" * 50] + ["".join(rng.choices("ab \n.é\n ", k=80)) for _ in range(25)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    out: dict = {}
    for r in tokens.count_by_section(docs, rule).collect():
        out.setdefault(r.doc_id, {})[r.section] = (r.char_start, r.char_end, r.n_tokens)
    for k, text in enumerate(texts):
        sections = re.findall(r"[^\n]*\n|[^\n]+$", text) or [""]
        sections += [""] if text.endswith("\n") else []
        owner = [i for i, s in enumerate(sections) for _ in s.encode()]
        counts, at = Counter(), 0
        for token in encoding.encode_ordinary(text):
            size = len(encoding.decode_single_token_bytes(token))
            mine = Counter(owner[at : at + size])
            if rule == "split":
                for i, n in mine.items():
                    counts[i] += n / size
            else:
                counts[{"start": owner[at], "end": owner[at + size - 1], "most": max(mine, key=lambda i: (mine[i], -i))}[rule]] += 1
            at += size
        edges = np.cumsum([0] + [len(s) for s in sections])
        assert len(out[k]) == len(sections)
        for i in range(len(sections)):
            assert out[k][i] == pytest.approx((edges[i], edges[i + 1], counts[i]))


# op10: features and votes


def test_trigram_features_against_plain_counts():
    rng = random.Random(5)
    texts = ["", "a", "ab", "abc", "  a  ", "éa b!c", *("".join(rng.choices("ab .é1", k=40)) for _ in range(20))]
    code: dict = {}
    for row, counts in language._counts(pa.array([t.encode() for t in texts]), 1 << 12):
        plain = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in texts[row].encode())
        grams = Counter(plain[i : i + 3] for i in range(len(plain) - 2) if plain[i : i + 3] != b"   ")
        assert counts.sum() == sum(grams.values())
        for g in grams:
            code.setdefault(g, None)
    for g in code:  # a trigram's bin is the same in every text
        code[g] = int(next(language._counts(pa.array([g]), 1 << 12))[1].argmax())
    for row, counts in language._counts(pa.array([t.encode() for t in texts]), 1 << 12):
        plain = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in texts[row].encode())
        by_bin = Counter(code[plain[i : i + 3]] for i in range(len(plain) - 2) if plain[i : i + 3] != b"   ")
        assert {k: int(v) for k, v in enumerate(counts) if v} == by_bin


def test_votes_against_plain_counting():
    rng = np.random.default_rng(2)
    families = {"f": ["a", "b", "c"], "g": ["d"], "h": ["e", "k"]}
    names = [("family", x, y) for x, y in itertools.combinations(sorted(families), 2)] + [(f, x, y) for f, langs in families.items() for x, y in itertools.combinations(sorted(langs), 2)]
    model = language.Model(families, {k: (rng.normal(size=8), rng.normal()) for k in names})
    for _ in range(100):
        counts = rng.integers(0, 9, 8).astype(float)
        x = np.sqrt(counts / max(1, counts.sum()))

        def winner(level, among):
            if len(among) == 1:
                return among[0], 1.0
            margin = {(p, q): (float(x @ model.machines[(level, p, q)][0]) + model.machines[(level, p, q)][1]) for p, q in itertools.combinations(sorted(among), 2)}
            of = lambda n: [m if p == n else -m for (p, q), m in margin.items() if n in (p, q)]
            best = max(among, key=lambda n: (sum(m > 0 for m in of(n)), sum(of(n)), n))
            return best, 1 / (1 + math.exp(-4 * min(of(best))))

        f, sure = winner("family", sorted(families))
        lang, surer = winner(f, families[f])
        assert model.predict(counts) == (lang, pytest.approx(sure * surer))


def test_pipeline_keeps_texts_where_no_language_is_known(spark):
    rows = [(1, "some words here", None), (2, "...", None), (3, None, None)]
    assert [r.doc_id for r in language.with_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()] == [1]


def test_null_languages_are_filled(spark):
    rng = random.Random(1)
    sounds = {"en": ["the", "ing", "sh"], "fr": ["eau", "oi", "ç"]}
    rows = [(k, " ".join("".join(rng.choices(sounds[x], k=3)) for _ in range(20)), x if k % 5 else None) for k in range(100) for x in [("en", "fr")[k % 2]]]
    out = language.with_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).orderBy("doc_id").collect()
    assert len(out) == 100 and sum(r.lang == ("en", "fr")[r.doc_id % 2] for r in out) >= 98
