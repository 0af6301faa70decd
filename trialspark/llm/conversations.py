"""Conversation structure repair: the cheapest edits that make roles alternate, by a dynamic program with checkpoints.

A conversation's rows, by turn (nulls first; of one turn by role and the text's MD5), are to read system? (user
assistant)+, or nothing. Edits are Keep (0), Rerole to user or assistant (2), Delete (3; a must for blank rows and for
repeats of an earlier role and text) and Insert an empty user or assistant turn (2); a truncated row that stays costs 1.
Four states (nothing yet, system, user, assistant) tell what role is asked for next, so letters of edits and rows fix all.

Backward vectors of costs, one number a state, are stored only at checkpoints, about a square root of the rows apart. The
walk forward recomputes the vectors of one stretch between checkpoints at a time and takes the least tight letter in ASCII
order (D, I, K, R); equally cheap edits of one conversation never are prefixes of each other, so that is the least string.

Conversations of up to `block` rows and `room` bytes are one stretch, solved where their texts are streamed, sorted. Of a
longer one, slim rows (no texts) are dealt by range and cut into blocks, each a checkpoint: every block gives the least
cost from each state to each other, a stream over blocks turns them into vectors at the blocks' ends, each block walks
from each of the four states, a second stream picks the state it really starts in, and only then are edits emitted. They
meet the texts in the same last stream, which holds no more than a batch of a long conversation: SHA-256 and one string of
edits need its rows in order, nothing else does.

Edge cases: null roles and texts count as one space; a null conv_id counts as the least id, null turns come first and are
no gap; repeated rows are duplicates; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, reduce
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialspark.llm.common import crc32_sql, documents, id_key, small_batches, stored
from trialspark.operators.ordered import PART, dealt

DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: Rows and bytes of text of a conversation that one task solves by itself.
BLOCK, ROOM = 4096, 1 << 25
#: Of the states nothing, system, user, assistant: the role that is asked for, and the state after it.
_ASKED, _NEXT = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
#: Costs from the states behind the last row.
END = (0, 2 * INSERT, INSERT, 0)
_FAR = 1 << 50
#: A row's code: 0 must go, else 1 + 2 * kind + whether it is truncated; kinds are the role's initial.
_KINDS = "sua"


def code_of(role: Column, text: Column) -> Column:
    """Code of a row as far as it shows by itself: 0 for a blank one."""
    initial = F.substring(role, 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    cut = (~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")).cast("int")
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), 1 + 2 * kind + cut).otherwise(0).cast("int")


def _kept(code: int, state: int) -> int | None:
    """The state after keeping a row, if that is allowed."""
    kind = (code - 1) // 2
    if kind == 0:
        return 1 if state == 0 else None
    if kind == 1:
        return 2 if state != 2 else None
    return 3 if kind == 2 and state == 2 else None


@cache
def _step(code: int, after: tuple[int, ...]) -> tuple[int, ...]:
    out = []
    for state in range(4):
        best = DELETE + after[state]
        if code:
            cost = TRUNCATED * ((code - 1) % 2)
            best = min(best, REROLE + cost + after[_NEXT[state]])
            if (to := _kept(code, state)) is not None:
                best = min(best, cost + after[to])
        out.append(best)
    a, b = out[2], out[3]
    out[2], out[3] = min(a, INSERT + b), min(b, INSERT + a)
    out[0], out[1] = min(out[0], INSERT + out[2]), min(out[1], INSERT + out[2])
    return tuple(out)


def _before(code: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs ahead of a row from those behind it; steps are kept by their differences, of which there are few."""
    least = min(after)
    return tuple(min(_FAR, x + least) for x in _step(code, tuple(min(_FAR, x - least) for x in after)))


def _ahead(codes: list[int], after: tuple[int, ...]) -> tuple[int, ...]:
    return reduce(lambda v, c: _before(c, v), reversed(codes), after)


def _letter(code: int, state: int, here: tuple[int, ...], after: tuple[int, ...]) -> str:
    """The least tight edit."""
    if here[state] == DELETE + after[state]:
        return "D"
    if here[state] == INSERT + here[_NEXT[state]]:
        return "I"
    to = _kept(code, state)
    return "K" if to is not None and here[state] == TRUNCATED * ((code - 1) % 2) + after[to] else "R"


def after_edit(letter: str, code: int, state: int) -> int:
    if letter == "D":
        return state
    return _kept(code, state) if letter == "K" else _NEXT[state]


def walk(codes: list[int], end: tuple[int, ...] = END, state: int = 0) -> tuple[list[str], int]:
    """Edits up to and with each row, from a state ahead of the first to costs behind the last, and the state there."""
    n = len(codes)
    step = isqrt(n) + 1
    stretches = range(0, n, step)
    checkpoints = {}
    for low in reversed(stretches):
        checkpoints[low] = end
        end = _ahead(codes[low : low + step], end)
    out = []
    for low in stretches:
        part = codes[low : low + step]
        vectors = [checkpoints[low]]
        for c in reversed(part):
            vectors.append(_before(c, vectors[-1]))
        vectors.reverse()
        for c, here, after in zip(part, vectors, vectors[1:], strict=False):
            letters = ""
            while not letters or letters[-1] == "I":
                letters += _letter(c, state, here, after)
                state = after_edit(letters[-1], c, state)
            out.append(letters)
    return out, state


def last_inserts(state: int) -> str:
    return "I" * (END[state] // INSERT)


def _least_costs(codes: list[int]) -> list[int]:
    """Least costs from each state ahead of a block to each state behind it, row by row."""
    columns = [_ahead(codes, tuple(0 if p == q else _FAR for q in range(4))) for p in range(4)]
    return [columns[p][q] for q in range(4) for p in range(4)]


class _Conversation:
    """What is told of one conversation while its rows pass."""

    def __init__(self, key, rows: bool):
        self.key, self.rows, self.out = key, [] if rows else None, 0
        self.low = self.high = self.initial = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = self.state = 0
        self.audit, self.sha, self.first = [], hashlib.sha256(), True

    def seen(self, turn, role: str, code: int, repeated: bool) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        self.blank += code == 0
        self.duplicate += code != 0 and repeated
        self.truncated += code != 0 and not repeated and (code - 1) % 2
        self.illegal += self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]

    def edit(self, letters: str, code: int, role: str, text: str) -> None:
        self.audit.append(letters)
        for x in letters:
            if x == "D":
                self.cost += DELETE
                continue
            if x == "I":
                self.cost += INSERT
                self._put(x, _ASKED[self.state], "")
            else:
                self.cost += TRUNCATED * ((code - 1) % 2) + REROLE * (x == "R")
                self._put(x, _ASKED[self.state] if x == "R" else role, text)
            self.state = after_edit(x, code, self.state)

    def _put(self, letter: str, role: str, text: str) -> None:
        if self.rows is not None:
            self.rows.append((self.key, self.out, role, text, letter))
            self.out += 1
            return
        self.sha.update(("" if self.first else "\n").encode() + f"{role}:{text}".encode())
        self.first = False

    def told(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.key, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


_AUDIT = "_key long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_ROWS = "_key long, n long, role string, text string, edit string"
_HEAD, _ROW, _TAIL = 0, 1, 2


def _streamed(batches, rows: bool) -> Iterator[pa.RecordBatch]:
    """Audits (rows: repaired rows) of sorted (key, place, turn, role, digest, kind, code, text, edit)."""
    schema = _ROWS if rows else _AUDIT
    types = {"long": pa.int64(), "string": pa.string()}
    fields = pa.schema([(n, types[t]) for n, t in (x.split() for x in schema.split(", "))])
    now, held, long, edits, last, done = None, [], False, "", None, []

    def finished():
        if not long:
            seen, codes = set(), []
            for turn, role, digest, code, _ in held:
                repeated = (role, digest) in seen
                seen.add((role, digest))
                now.seen(turn, role, code, repeated)
                codes.append(0 if repeated else code)
            letters, _ = walk(codes)
            for x, code, (_, role, _, _, text) in zip(letters, codes, held, strict=True):
                now.edit(x, code, role, text)
            now.edit(last_inserts(now.state), 1, "", "")
        return now.rows if rows else [now.told()]

    def packed(data):
        return pa.RecordBatch.from_pydict({f.name: pa.array([r[i] for r in data], f.type) for i, f in enumerate(fields)}, fields)

    for batch in batches:
        for key, place, turn, role, digest, kind, code, text, edit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or key != now.key:
                if now is not None:
                    done += finished()
                now, held, long, last = _Conversation(key, rows), [], False, None
            if place == _HEAD:
                long = True
            elif place == _TAIL:
                now.edit(edit, 1, "", "")
            elif kind == 0:
                edits, first_code = edit, code  # of the next row; others equal to it go
            elif not long:
                held.append((turn, role, digest, code, text))
            else:
                again = (turn, role, digest) == last
                last = (turn, role, digest)
                now.seen(turn, role, code, again or (first_code == 0 and code != 0))
                now.edit("D" if again else edits, 0 if again else first_code, role, text)
            if rows and long and now.rows:
                done += now.rows
                now.rows = []
        if done:
            yield packed(done)
            done = []
    if now is not None and (done := finished()):
        yield packed(done)


_PLACE = ["_key", PART, "block"]


def _block_edits(blocks: DataFrame) -> DataFrame:
    """(_key, turn, role, digest, code, edit) of rows of blocks, and a last row of each conversation with null digest."""
    spark_key = "_key long, part long, block long"

    def solved(batches, f, schema):
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            out = [y for r in batch.to_pylist() for y in f(r)]
            yield pa.RecordBatch.from_pydict({n: [x[i] for x in out] for i, n in enumerate(names)}, _arrow(schema))

    def stream(df, backward, schema, f):
        order = [F.col(c).desc() if backward and c != "_key" else F.col(c).asc() for c in ("_key", "part", "block")]
        return df.repartition("_key").sortWithinPartitions(*order).mapInArrow(lambda b: solved(b, f(), schema), schema)

    def to_ends():
        key, v = None, END

        def f(r):
            nonlocal key, v
            if r["_key"] != key:
                key, v = r["_key"], END
            out = (r["_key"], r["part"], r["block"], list(v))
            v = tuple(min(_FAR, *(r["costs"][4 * q + p] + v[p] for p in range(4))) for q in range(4))
            return [out]

        return f

    def to_starts():
        key, state = None, 0

        def f(r):
            nonlocal key, state
            if r["_key"] != key:
                key, state = r["_key"], 0
            out = (r["_key"], r["part"], r["block"], state)
            state = r["exits"][state]
            return [out]

        return f

    def edits(r):
        letters, state = walk([x["code"] for x in r["rows"]], tuple(r["ends"]), r["state"])
        out = [(r["_key"], x["turn"], x["role"], x["digest"], x["code"], e) for x, e in zip(r["rows"], letters, strict=True)]
        return [*out, (r["_key"], None, None, None, 1, last_inserts(state))] if r["last"] else out

    place = ["_key", "part", "block"]
    codes = lambda r: [x["code"] for x in r["rows"]]
    costs = f"{spark_key}, costs array<long>"
    told = blocks.select(*place, "rows").mapInArrow(lambda b: solved(b, lambda r: [(r["_key"], r["part"], r["block"], _least_costs(codes(r)))], costs), costs)
    ends = stored(stream(told, True, f"{spark_key}, ends array<long>", to_ends), "ends")
    exits = f"{spark_key}, exits array<long>"
    with_ends = blocks.join(ends, place)
    told = with_ends.mapInArrow(lambda b: solved(b, lambda r: [(r["_key"], r["part"], r["block"], [walk(codes(r), tuple(r["ends"]), q)[1] for q in range(4)])], exits), exits)
    starts = stored(stream(told, False, f"{spark_key}, state long", to_starts), "starts")
    schema = "_key long, turn long, role string, digest string, code int, edit string"
    return with_ends.join(starts, place).mapInArrow(lambda b: solved(b, edits, schema), schema)


def _arrow(schema: str) -> pa.Schema:
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, types[t]) for n, t in (x.split(" ", 1) for x in schema.split(", "))])


def _long_edits(slim: DataFrame, block: int) -> DataFrame:
    """Edits of long conversations' rows (_key, turn, role, digest, code); equal rows are one here."""
    each = slim.groupBy("_key", "turn", "role", "digest").agg(F.min("code").alias("code"))
    place = F.struct(F.col("turn").isNotNull().alias("told"), "turn")
    firsts = each.groupBy("_key", "role", "digest").agg(F.min(place).alias("_first"))
    code = F.when(place == F.col("_first"), F.col("code")).otherwise(0)
    flagged = each.join(firsts, ["_key", "role", "digest"]).select("_key", "turn", "role", "digest", code.alias("code"))
    parts = dealt(flagged, ["_key"], ["turn", "role", "digest"])
    nth = F.row_number().over(Window.partitionBy("_key", PART).orderBy("turn", "role", "digest"))
    numbered = parts.withColumn("nth", nth).withColumn("block", F.floor((F.col("nth") - 1) / block))
    rows = F.sort_array(F.collect_list(F.struct("nth", "turn", "role", "digest", "code"))).alias("rows")
    blocks = numbered.groupBy("_key", F.col(PART).cast("long").alias("part"), "block").agg(rows)
    last = blocks.groupBy("_key").agg(F.max(F.struct("part", "block")).alias("_last"))
    blocks = blocks.join(last, "_key").select("_key", "part", "block", "rows", (F.struct("part", "block") == F.col("_last")).alias("last"))
    return _block_edits(stored(blocks, "blocks"))


def _repaired(rows: DataFrame, as_rows: bool, block: int, room: int) -> DataFrame:
    small_batches(rows.sparkSession)
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    filled = rows.select(id_key("conv_id").alias("_key"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    sizes = filled.groupBy("_key").agg(F.count("*").alias("_n"), F.sum(F.octet_length("text")).alias("_bytes"))
    long = stored(sizes.filter((F.col("_n") > block) | (F.col("_bytes") > room)).select("_key"), "long")
    told = filled.select("_key", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"), code_of(F.col("role"), F.col("text")).alias("code"), "text")
    shape = lambda df, place, kind: df.select("_key", F.lit(place).alias("_place"), "turn", "role", "digest", F.lit(kind).alias("_kind"), "code", "text", "edit")
    stream = shape(told.withColumn("edit", F.lit(None).cast("string")), _ROW, 1)
    if not long.isEmpty():
        edits = stored(_long_edits(told.drop("text").join(long, "_key", "left_semi"), block), "edits").withColumn("text", F.lit(None).cast("string"))
        heads = long.select("_key", *(F.lit(None).cast(t).alias(n) for n, t in (("turn", "long"), ("role", "string"), ("digest", "string"), ("code", "int"), ("text", "string"), ("edit", "string"))))
        stream = stream.unionByName(shape(heads, _HEAD, 0)).unionByName(shape(edits.filter("digest IS NOT NULL"), _ROW, 0)).unionByName(shape(edits.filter("digest IS NULL"), _TAIL, 0))
    dealt_out = stream.repartition("_key").sortWithinPartitions("_key", "_place", "turn", "role", "digest", "_kind")
    out = dealt_out.mapInArrow(lambda b: _streamed(b, as_rows), _ROWS if as_rows else _AUDIT)
    return out.select(F.when(F.col("_key") != F.lit(-(1 << 63)), F.col("_key")).alias("conv_id"), *out.columns[1:])


def audits(rows: DataFrame, block: int = BLOCK, room: int = ROOM) -> DataFrame:
    """Per conversation of rows (conv_id, turn, role, text): gaps in turns, rows that are blank, duplicate, truncated (the
    first that holds), illegal pairs of roles, the edits' cost, their letters, and SHA-256 of the repaired conversation."""
    return _repaired(rows, False, block, room)


def repair_conversations(rows: DataFrame, block: int = BLOCK, room: int = ROOM) -> DataFrame:
    """The repaired conversations' rows: conv_id, n (from 0), role, text and the edit (I, K or R) that made the row."""
    return _repaired(rows, True, block, room)


def damaged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text; null roles and texts are one space) with faults by the CRC-32 of conv_id:turn,
    a null being one space there, modulo 20: 0 row gone, 1 text emptied, 2 its stops removed, 3 row twice, 4 role user."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.when(F.col("_f") == 1, "").when(F.col("_f") == 2, F.regexp_replace(name("text"), "[.!?]", "")).otherwise(name("text"))
    role = F.when(F.col("_f") == 4, "user").otherwise(name("role"))
    kept = rows.withColumn("_f", fault).filter("_f <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), "_f")
    return kept.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(1), F.when(F.col("_f") == 3, 2).otherwise(1))).alias("_copy")).drop("_copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ids = rows.select(id_key("conv_id").alias("_key")).distinct()
    told = audits(damaged(rows)).withColumn("_key", id_key("conv_id")).drop("conv_id")
    out = ids.join(told, "_key", "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    conv_id = F.when(F.col("_key") != F.lit(-(1 << 63)), F.col("_key"))
    return out.select(conv_id.alias("conv_id"), *(F.coalesce(c, F.lit(0)).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


#: Vectors backward over rows, then one letter a step; q is the state + 1.
OP13_SQL = rf"""
WITH RECURSIVE o AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
m AS (SELECT *, {crc32_sql("k")} % 20 AS f FROM o),
d AS (SELECT c, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy FROM m WHERE f <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, count(*) OVER (PARTITION BY c) AS n FROM d),
g AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS bl, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS du,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS tr, substr(role, 1, 1) AS ini, lag(substr(role, 1, 1)) OVER (PARTITION BY c ORDER BY i) AS ahead FROM r),
x AS (SELECT c, i, n, role, text, ini, bl OR du AS gone, CASE WHEN bl OR du THEN 0 ELSE tr::INT END AS t FROM g),
b AS (SELECT c, n + 1 AS i, [0, 4, 2, 0] AS v FROM x WHERE i = 1 UNION ALL
    SELECT c, i, [least(w[1], 2 + w[3], 4 + w[4]), least(w[2], 2 + w[3], 4 + w[4]), least(w[3], 2 + w[4]), least(w[4], 2 + w[3])] FROM (
        SELECT b.c, x.i, list_transform([1, 2, 3, 4], lambda q: least(3 + v[q], CASE WHEN gone THEN 1000000 ELSE t + least(2 + v[CASE q WHEN 3 THEN 4 ELSE 3 END],
            CASE WHEN ini = 's' AND q = 1 THEN v[2] WHEN ini = 'u' AND q <> 3 THEN v[3] WHEN ini = 'a' AND q = 3 THEN v[4] ELSE 1000000 END) END)) AS w
        FROM b JOIN x ON x.c = b.c AND x.i = b.i - 1)),
y AS (SELECT x.*, h.v AS h, a.v AS a FROM x JOIN b h ON h.c = x.c AND h.i = x.i JOIN b a ON a.c = x.c AND a.i = x.i + 1),
z AS (SELECT c, 1::BIGINT AS i, 1 AS q, '' AS audit, 0 AS cost, [''] AS body, 0 AS step FROM x WHERE i = 1 UNION ALL
    SELECT c, i + (e <> 'I')::INT, CASE WHEN e = 'D' THEN q WHEN e = 'K' AND ini = 's' THEN 2 WHEN q = 3 THEN 4 ELSE 3 END, audit || e,
        cost + CASE e WHEN 'D' THEN 3 WHEN 'I' THEN 2 WHEN 'K' THEN t ELSE 2 + t END,
        CASE e WHEN 'D' THEN body ELSE list_append(body, CASE WHEN e = 'K' THEN role WHEN q = 3 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END) END, step + 1 FROM (
        SELECT z.*, y.t, y.ini, y.role, y.text, CASE WHEN y.c IS NULL THEN 'I' WHEN h[q] = 3 + a[q] THEN 'D' WHEN h[q] = 2 + h[CASE q WHEN 3 THEN 4 ELSE 3 END] THEN 'I'
            WHEN ini = 's' AND q = 1 AND h[q] = t + a[2] OR ini = 'u' AND q <> 3 AND h[q] = t + a[3] OR ini = 'a' AND q = 3 AND h[q] = t + a[4] THEN 'K' ELSE 'R' END AS e
        FROM z LEFT JOIN y ON y.c = z.c AND y.i = z.i WHERE y.c IS NOT NULL OR q IN (2, 3))),
s AS (SELECT c, arg_max(audit, step) AS audit, arg_max(cost, step) AS cost, arg_max(body, step) AS body FROM z GROUP BY c),
u AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (bl) AS blank, count(*) FILTER (NOT bl AND du) AS duplicate,
    count(*) FILTER (NOT bl AND NOT du AND tr) AS truncated, count(*) FILTER (ahead IS NOT NULL AND ahead || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY c)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
    coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(body[2:], chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM o) LEFT JOIN u USING (c) LEFT JOIN s USING (c)
"""
