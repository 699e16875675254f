"""Conversation structure repair: the cheapest edits that turn each conversation into s?(ua)+ or nothing.

Window functions flag the faults of each turn; a conversation's turns are collected as sorted structs, and
aggregate() folds them over four states by what was said last: nothing (e), system (s), user (u) or
assistant (a). Each state carries a (cost, audit) struct, and native least() takes the cheaper one, or of
equal costs the audit that comes first. In a carried audit J and S are an Insert and a Rerole that
give an assistant; they stand for I and R, and can't meet them in a comparison, since equal beginnings
lead to equal states.

Conversations beyond TURNS turns or BYTES bytes are never collected: they are sorted by range over many
tasks, each stretch of TURNS turns is folded from all four states, and stretches are composed FAN at a time,
which gives the same costs and audits. Their hash alone, sequential by its definition, is made by
one task for a conversation, from a sorted stream of turns that it doesn't hold.
"""

from __future__ import annotations

import hashlib
import itertools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.baselines import crc32_sql
from quire.llm.shared import cut, discard, scratch_path, written

#: Turns and bytes of a conversation that is collected whole; stretches that are composed at once; conversations that are broadcast by id.
TURNS, BYTES, FAN, BROADCAST_IDS = 1024, 16 << 20, 64, 65536
SPACE = " \t\n\x0b\x0c\r"
#: Above any cost.
FAR = 1 << 40
STATES = ("e", "s", "u", "a")
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, alive): damaged turns, by the crc32 of "conv_id:turn" modulo 20.

    0 drops the turn, of which a row that is not alive stays to name its conversation; 1 empties the
    text; 2 takes its stops; 3 repeats it; 4 makes it a user's. A null counts as one space, but turn and conv_id stay null.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    copies = F.when(kind == 0, F.array(F.lit(False))).when(kind == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(F.lit(True)))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 0, "").when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind <= 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(copies).alias("alive"),
    )


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _put(state: Column, cost: Column | int, mark: str) -> Column:
    return F.struct((state["cost"] + cost).alias("cost"), F.concat(state["audit"], F.lit(mark)).alias("audit"))


def _far() -> Column:
    return F.struct(F.lit(FAR).alias("cost"), F.lit("").alias("audit"))


def _start(state: str) -> Column:
    own = F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit"))
    return F.struct(*((own if s == state else _far()).alias(s) for s in STATES))


def _inserted(acc: Column, body) -> Column:
    """body of the states after the cheapest Inserts: a user after anything but a user, an assistant after that."""
    users = F.least(acc["u"], *(_put(acc[s], 2, "I") for s in ("e", "s", "a")))
    return _let(
        F.struct(acc["e"].alias("e"), acc["s"].alias("s"), users.alias("u"), acc["a"].alias("a")),
        lambda c: _let(F.struct(c["e"].alias("e"), c["s"].alias("s"), c["u"].alias("u"), F.least(c["a"], _put(c["u"], 2, "J")).alias("a")), body),
    )


def _step(acc: Column, turn: Column) -> Column:
    """The four states after a turn (initial, fault)."""
    initial, extra = turn["initial"], F.when(turn["fault"] == 3, 1).otherwise(0)
    must_go = turn["fault"].isin(1, 2)

    def after(c: Column) -> Column:
        def reach(state: str, came: Column, rerole: str | None) -> Column:
            kept = F.when(initial == state, _put(came, extra, "K")).otherwise(_put(came, extra + 2, rerole) if rerole else _far())
            gone = _put(c[state], 3, "D")
            return F.when(must_go, gone).otherwise(F.least(gone, kept)).alias(state)

        return F.struct(_put(c["e"], 3, "D").alias("e"), reach("s", c["e"], None), reach("u", F.least(c["e"], c["s"], c["a"]), "R"), reach("a", c["u"], "S"))

    return _inserted(acc, after)


def _composed(first: Column, second: Column) -> Column:
    """States after two stretches; first has the states after the one, second those of the other from each state."""

    def to(state: str) -> Column:
        ways = (F.struct((first[m]["cost"] + second[i][state]["cost"]).alias("cost"), F.concat(first[m]["audit"], second[i][state]["audit"]).alias("audit")) for i, m in enumerate(STATES))
        return F.least(*ways).alias(state)

    return F.struct(*(to(s) for s in STATES))


def _ended(states: Column) -> Column:
    """(cost, audit) of the cheapest whole repair."""
    return _inserted(states, lambda c: F.least(c["e"], c["a"]))


def _plain(audit: Column) -> Column:
    return F.translate(audit, "JS", "IR")


def _flagged(turns: DataFrame, keys: list[str], seen: Column, order: list[Column]) -> DataFrame:
    """turns with initial, fault (1 blank, 2 duplicate, 3 truncated, else 0), illegal and fresh (a turn number that the one before hasn't)."""
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(bare == "", 1).when(seen, 2).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    w = Window.partitionBy(*keys).orderBy(*order)
    known = turns.withColumn("initial", F.substring("role", 1, 1)).withColumn("fault", fault)
    before, last = F.lag("initial").over(w), F.lag("turn").over(w)
    return known.withColumns(
        {
            "illegal": F.coalesce((~F.concat(before, "initial").isin("su", "ua", "au")).cast("long"), F.lit(0).cast("long")),
            "fresh": (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(last)).cast("long"),
        }
    )


def _count(condition: Column, name: str) -> Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0).cast("long")).alias(name)


def _summed(alive: Column) -> list[Column]:
    return [
        *(_count(alive & (F.col("fault") == i), name) for i, name in ((1, "blank"), (2, "duplicate"), (3, "truncated"))),
        _count(alive & (F.col("illegal") == 1), "illegal"),
        _count(alive & (F.col("fresh") == 1), "fresh"),
        F.min(F.when(alive, F.col("turn"))).alias("least_turn"),
        F.max(F.when(alive, F.col("turn"))).alias("last_turn"),
    ]


def _gaps() -> Column:
    return F.coalesce(F.col("last_turn") - F.col("least_turn") + 1 - F.col("fresh"), F.lit(0)).cast("long").alias("gaps")


def _said(role: str, text: Column | None = None) -> Column:
    return F.struct(F.lit(role).alias("role"), (F.lit("") if text is None else text).alias("text"))


def _repaired(turns: Column, audit: Column) -> Column:
    """The repaired turns as structs (role, text)."""

    def kept(turn: Column, marks: Column) -> Column:
        def one(mark: Column) -> Column:
            own = F.struct(turn["role"].alias("role"), turn["text"].alias("text"))
            return F.when(mark == "K", own).when(mark == "R", _said("user", turn["text"])).when(mark == "S", _said("assistant", turn["text"])).when(mark == "I", _said("user")).when(mark == "J", _said("assistant"))

        return F.filter(F.transform(F.split(marks, ""), one), lambda x: x.isNotNull())

    pieces = F.regexp_extract_all(audit, F.lit("([IJ]*[DKRS])"), 1)
    tail = F.transform(F.filter(F.split(F.regexp_extract(audit, "([IJ]*)$", 1), ""), lambda x: x != ""), lambda x: F.when(x == "I", _said("user")).otherwise(_said("assistant")))
    return F.concat(F.flatten(F.zip_with(turns, pieces, kept)), tail)


def _collected(turns: DataFrame) -> DataFrame:
    """Conversations that are collected whole: (conv_id, COUNTS, cost, carried audit, turns)."""
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    turns = turns.repartition("conv_id")  # serves the windows and the grouping
    place = F.row_number().over(Window.partitionBy("conv_id", "alive").orderBy(*order))
    seen = F.row_number().over(Window.partitionBy("conv_id", "alive", "role", "text").orderBy("place")) > 1
    flagged = _flagged(turns.withColumn("place", place).withColumn("seen", seen), ["conv_id", "alive"], F.col("seen"), [F.asc("place")])
    alive = F.col("alive")
    met = flagged.groupBy("conv_id").agg(*_summed(alive), F.sort_array(F.collect_list(F.when(alive, F.struct("place", "initial", "fault", "role", "text")))).alias("turns"))
    best = _ended(F.aggregate("turns", _start("e"), _step))
    return met.select("conv_id", _gaps(), *COUNTS[1:], "turns", best.alias("best")).select("conv_id", *COUNTS, "best.cost", "best.audit", "turns")


def _placed(turns: DataFrame, path: str) -> DataFrame:
    """Turns of long conversations, written in order, with their place in it: no task holds a conversation."""
    spark, order = turns.sparkSession, ["conv_id", "turn", "role", "text"]
    dealt = turns.drop("alive").repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions(*(F.asc_nulls_first(c) for c in order))
    numbered = written(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "turns", path)
    # as many numbers as Spark has partitions
    before, offsets = 0, []
    for part, n in sorted((r.part, r.n) for r in numbered.groupBy("part").agg(F.count("*").alias("n")).collect()):
        offsets.append((part, before))
        before += n
    start = F.broadcast(spark.createDataFrame(offsets, "part int, start long"))
    return numbered.join(start, "part").select(*order, (F.col("start") + F.col("row").bitwiseAND(F.lit((1 << 33) - 1))).alias("place"))


def _same(a: DataFrame, b: DataFrame, columns: list[str], how: str) -> DataFrame:
    """a joined to b by columns, in which nulls are equal."""
    named = b.withColumnsRenamed({c: f"other_{c}" for c in columns})
    condition = F.lit(True)
    for c in columns:
        condition &= a[c].eqNullSafe(named[f"other_{c}"])
    return a.join(named, condition, how).drop(*(f"other_{c}" for c in columns))


def _stretched(placed: DataFrame, size: int = TURNS) -> DataFrame:
    """Long conversations by stretches that are folded from every state, and composed: (conv_id, COUNTS, cost, carried audit)."""
    digest = F.sha2("text", 256)
    first = placed.groupBy("conv_id", "role", digest.alias("digest")).agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    known = _same(placed.withColumn("digest", digest), first, ["conv_id", "role", "digest"], "left").withColumn("stretch", F.expr(f"place div {size}"))
    narrow = known.select("conv_id", "stretch", "place", "turn", "role", "text", F.coalesce(F.col("place") > F.col("first"), F.lit(False)).alias("seen"))
    flagged = _flagged(narrow, ["conv_id", "stretch"], F.col("seen"), [F.asc("place")]).drop("text", "role")
    whole = flagged.groupBy("conv_id", "stretch").agg(
        *_summed(F.lit(True)),
        F.min(F.struct("place", "initial", "turn")).alias("head"),
        F.max(F.struct("place", "initial", "turn")).alias("tail"),
        F.sort_array(F.collect_list(F.struct("place", "initial", "fault"))).alias("turns"),
    )
    level = cut(whole.withColumn("ways", F.array(*(F.aggregate("turns", _start(s), _step) for s in STATES))).drop("turns"))
    while level.groupBy("conv_id").count().filter("count > 1").limit(1).count():
        level = cut(_met(level))
    best = _ended(F.col("ways")[0])
    return level.select("conv_id", _gaps(), *COUNTS[1:], best.alias("best")).select("conv_id", *COUNTS, "best.cost", "best.audit")


def _met(level: DataFrame) -> DataFrame:
    """FAN stretches that follow each other become one."""
    parts = [c for c in level.columns if c not in ("conv_id", "stretch")]
    met = level.groupBy("conv_id", F.expr(f"stretch div {FAN}").alias("above")).agg(F.sort_array(F.collect_list(F.struct("stretch", *(c for c in parts if c != "ways")))).alias("parts"), F.collect_list(F.struct("stretch", "ways")).alias("unsorted"))
    # structs of arrays of structs have an order as well, but the stretch alone decides
    ways = F.transform(F.sort_array("unsorted"), lambda x: x["ways"])
    total = lambda name: F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p[name])
    pairs = F.zip_with(F.slice("parts", 1, F.size("parts") - 1), F.slice("parts", F.lit(2), F.size("parts")), lambda p, q: F.struct(p["tail"].alias("tail"), q["head"].alias("head")))
    over = lambda test: F.size(F.filter(pairs, test)).cast("long")
    crossing = over(lambda x: F.coalesce(~F.concat(x["tail"]["initial"], x["head"]["initial"]).isin("su", "ua", "au"), F.lit(False)))
    again = over(lambda x: x["tail"]["turn"].isNotNull() & x["tail"]["turn"].eqNullSafe(x["head"]["turn"]))
    return met.select(
        "conv_id",
        F.col("above").alias("stretch"),
        *(total(c).alias(c) for c in ("blank", "duplicate", "truncated")),
        (total("illegal") + crossing).alias("illegal"),
        (total("fresh") - again).alias("fresh"),
        F.array_min(F.transform("parts", lambda p: p["least_turn"])).alias("least_turn"),
        F.array_max(F.transform("parts", lambda p: p["last_turn"])).alias("last_turn"),
        F.col("parts")[0]["head"].alias("head"),
        F.element_at("parts", -1)["tail"].alias("tail"),
        F.array(*(F.aggregate(F.slice(ways, F.lit(2), F.size(ways)), ways[0][i], _composed) for i in range(len(STATES)))).alias("ways"),
    )


def _stream(repairs: DataFrame, placed: DataFrame) -> DataFrame:
    """Turns of long conversations in order, behind a row with their repair, whose place is -1."""
    fields, none = [c for c in repairs.columns if c != "conv_id"], F.lit(None)
    heads = repairs.select("conv_id", F.lit(-1).cast("long").alias("place"), none.cast("string").alias("role"), none.cast("string").alias("text"), *fields)
    turns = placed.select("conv_id", "place", "role", "text", *(none.cast("string" if c == "audit" else "long").alias(c) for c in fields))
    return heads.unionByName(turns).repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "place")


def _read(batches):
    """(head, turns) of each conversation of a stream; turns yields what the repair says, and holds one turn."""
    rows = (row for batch in batches for start in range(0, batch.num_rows, 256) for row in batch.slice(start, 256).to_pylist())

    def said(head: dict, turns):
        at, audit = 0, head["audit"]
        inserted = {"I": ("user", ""), "J": ("assistant", "")}
        for row in turns:
            while audit[at] in inserted:
                yield inserted[audit[at]]
                at += 1
            mark, at = audit[at], at + 1
            if mark != "D":
                yield {"K": row["role"], "R": "user", "S": "assistant"}[mark], row["text"]
        for mark in audit[at:]:
            yield inserted[mark]

    head, ahead = next(rows, None), None
    while head is not None:
        ended = False

        def own():
            nonlocal ahead, ended
            for row in rows:
                if row["place"] < 0:
                    ahead = row
                    break
                yield row
            else:
                ahead = None
            ended = True

        turns = own()
        yield head, said(head, turns)
        for _ in turns:  # what nobody read
            pass
        head = ahead if ended else None


def _hashed(repairs: DataFrame, placed: DataFrame) -> DataFrame:
    """repairs of long conversations with repaired_sha256."""
    fields = ("conv_id", *COUNTS, "cost", "audit")
    target = pa.schema([(c, pa.string() if c in ("audit", "repaired_sha256") else pa.int64()) for c in (*fields, "repaired_sha256")])

    def run(batches):
        for head, turns in _read(batches):
            digest, between = hashlib.sha256(), b""
            for role, text in turns:
                digest.update(between + f"{role}:{text}".encode())
                between = b"\n"
            plain = head["audit"].translate(str.maketrans("JS", "IR"))
            yield pa.RecordBatch.from_pylist([{c: head[c] for c in fields} | {"audit": plain, "repaired_sha256": digest.hexdigest()}], schema=target)

    return _stream(repairs, placed).mapInArrow(run, f"conv_id long, {', '.join(f'{c} long' for c in COUNTS)}, cost long, audit string, repaired_sha256 string")


def _spoken(repairs: DataFrame, placed: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the repaired turns of long conversations."""

    def run(batches):
        for head, turns in _read(batches):
            place = 0
            while some := list(itertools.islice(turns, 256)):
                columns = [[head["conv_id"]] * len(some), list(range(place + 1, place + len(some) + 1)), *(list(c) for c in zip(*some, strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["conv_id", "place", "role", "text"])
                place += len(some)

    return _stream(repairs, placed).mapInArrow(run, "conv_id long, place long, role string, text string")


def _large(conversations: DataFrame, most_turns: int, most_bytes: int) -> DataFrame:
    sizes = conversations.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("bytes"))
    return cut(sizes.filter((F.col("n") > most_turns) | (F.col("bytes") > most_bytes)).select("conv_id"))


def _parted(turns: DataFrame, most_turns: int, most_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """Turns of conversations that are collected, and of the long ones, if there are any."""
    large = _large(turns, most_turns, most_bytes)
    n = large.limit(BROADCAST_IDS + 1).count()
    if not n:
        return turns, None
    ids = F.broadcast(large) if n <= BROADCAST_IDS else large
    return _same(turns, ids, ["conv_id"], "left_anti"), _same(turns, ids, ["conv_id"], "left_semi")


def repair(turns: DataFrame, path: str, most_turns: int = TURNS, most_bytes: int = BYTES) -> DataFrame:
    """(conv_id, COUNTS, cost, audit, repaired_sha256) of each conversation of turns(conv_id, turn, role, text, alive).

    A conversation's turns are taken by turn, nulls first, then role and text. Turns that are not alive
    only name their conversation; one without others has zeros, an empty audit and the hash of an empty
    text. role and text are not null; a null conv_id is a conversation of its own. Turns of long
    conversations are written to path, which must stay while the result is read.
    """
    whole, split = _parted(turns, most_turns, most_bytes)
    lines = F.transform(_repaired(F.col("turns"), F.col("audit")), lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    last = _collected(whole).select("conv_id", *COUNTS, "cost", _plain(F.col("audit")).alias("audit"), F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))
    if split is None:
        return last
    named = split.groupBy("conv_id").agg(F.max("alive").alias("any")).filter("not any").select("conv_id")
    zeros = named.select("conv_id", *(F.lit(0).cast("long").alias(c) for c in (*COUNTS, "cost")), F.lit("").alias("audit"), F.sha2(F.lit(""), 256).alias("repaired_sha256"))
    placed = _placed(split.filter("alive"), path)
    return last.unionByName(_hashed(_stretched(placed, most_turns), placed)).unionByName(zeros)


def repaired_turns(conversations: DataFrame, most_turns: int = TURNS, most_bytes: int = BYTES) -> DataFrame:
    """conversations(conv_id, turn, role, text) after repair: (conv_id, place, role, text), place from 1.

    A null role or text counts as one space; other columns are left out. Conversations whose turns
    all go have no rows; of long ones a task streams the turns.
    """
    spark, path, space = conversations.sparkSession, scratch_path(conversations.sparkSession, "turns"), F.lit(" ")
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), F.lit(True).alias("alive"))
    whole, split = _parted(turns, most_turns, most_bytes)
    each = _collected(whole).select("conv_id", F.posexplode(_repaired(F.col("turns"), F.col("audit"))).alias("at", "turn"))
    last = each.select("conv_id", (F.col("at") + 1).cast("long").alias("place"), "turn.role", "turn.text")
    if split is None:
        return last
    try:
        placed = _placed(split, path)
        return cut(last.unionByName(_spoken(_stretched(placed, most_turns), placed)))
    finally:
        discard(spark, path)


def describe(conversations: DataFrame, most_turns: int = TURNS, most_bytes: int = BYTES) -> DataFrame:
    """What repair() finds in conversations(conv_id, turn, role, text) that damage() has damaged, one row for every conv_id.

    Nulls in any column, empty and very long texts, turns that repeat or share a number and conversations of any
    length have a result; an empty table has an empty one, and other columns are ignored.
    """
    spark, path = conversations.sparkSession, scratch_path(conversations.sparkSession, "turns")
    try:
        plain = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
        return cut(repair(damage(plain), path, most_turns, most_bytes))
    finally:
        discard(spark, path)


def _add(key: str, cost: str, mark: str) -> str:
    return f"printf('%08d', left({key}, 8)::int + {cost}) || substr({key}, 9) || '{mark}'"


_ORDER = "turn nulls first, role, text"
_CLOSE = f"least(u, {_add('e', '2', 'I')}, {_add('s', '2', 'I')}, {_add('a', '2', 'I')})"
_SPOKEN = "case when {0} = 0 and sys then '' when ({0} % 2 = 1) = sys then 'user' else 'assistant' end"
#: The same by a recursive walk over turn numbers, with costs and audits in one text; roles of Inserts and Reroles come from their number.
CONVERSATION_SQL = f"""
with recursive b as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc32_sql("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as kind from conversations),
x as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
      from b, (select unnest([1, 2]) as copy) where kind <> 0 and (copy = 1 or kind = 3)),
o as (select *, row_number() over (partition by conv_id order by {_ORDER}) as k, left(role, 1) as c from x),
f as materialized (select *, case when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 1 when row_number() over (partition by conv_id, role, text order by k) > 1 then 2 when not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') then 3 else 0 end as fault,
      lag(c) over (partition by conv_id order by k) as prior from o),
n as (select conv_id, max(k) as last, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 3) as truncated,
      count(*) filter (prior || c not in ('su', 'ua', 'au')) as illegal from f group by conv_id),
r as (select distinct conv_id, 0::bigint as k, '00000000' as e, '90000000' as s, '90000000' as u, '90000000' as a from b
      union all
      select conv_id, k, {_add('e', '3', 'D')}, case when fault not in (1, 2) and c = 's' then least({_add('s', '3', 'D')}, {_add('e', 'extra', 'K')}) else {_add('s', '3', 'D')} end,
             case when fault in (1, 2) then {_add('u', '3', 'D')} when c = 'u' then least({_add('u', '3', 'D')}, {_add('least(e, s, a)', 'extra', 'K')}) else least({_add('u', '3', 'D')}, {_add('least(e, s, a)', '2 + extra', 'R')}) end,
             case when fault in (1, 2) then {_add('a', '3', 'D')} when c = 'a' then least({_add('a', '3', 'D')}, {_add('u', 'extra', 'K')}) else least({_add('a', '3', 'D')}, {_add('u', '2 + extra', 'R')}) end
      from (select conv_id, k, c, fault, extra, e, s, u, least(a, {_add('u', '2', 'I')}) as a
            from (select r.conv_id, f.k, f.c, f.fault, case when f.fault = 3 then 1 else 0 end as extra, e, s, {_CLOSE} as u, a from r join f on f.conv_id is not distinct from r.conv_id and f.k = r.k + 1))),
z as (select conv_id, least(e, a, {_add('u', '2', 'I')}) as best from (select r.conv_id, e, {_CLOSE} as u, a from r left join n on n.conv_id is not distinct from r.conv_id where r.k = coalesce(n.last, 0))),
q as materialized (select conv_id, left(best, 8)::bigint as cost, substr(best, 9) as audit, regexp_extract_all(substr(best, 9), 'I*[DKR]') as pieces from z),
v as (select q.conv_id, f.k, pieces[f.k] as piece, f.c, f.role, f.text, coalesce(sum(length(replace(pieces[f.k], 'D', ''))) over (partition by q.conv_id order by f.k rows between unbounded preceding and 1 preceding), 0)::bigint as said
      from q join f on f.conv_id is not distinct from q.conv_id),
y as (select conv_id, coalesce(bool_or(said = 0 and piece = 'K' and c = 's'), false) as sys, coalesce(sum(length(replace(piece, 'D', ''))), 0)::bigint as all_said from v group by conv_id),
l as (select v.conv_id, k, list_concat(list_transform(range(length(piece) - 1), lambda i: {_SPOKEN.format('(said + i)')} || ':'),
             case right(piece, 1) when 'K' then [role || ':' || text] when 'R' then [{_SPOKEN.format('(said + length(piece) - 1)')} || ':' || text] else []::varchar[] end) as lines
      from v join y on y.conv_id is not distinct from v.conv_id
      union all
      select q.conv_id, 9000000000000000000, list_transform(range(length(regexp_extract(audit, 'I*$'))), lambda i: {_SPOKEN.format('(coalesce(all_said, 0) + i)')} || ':') from q left join y on y.conv_id is not distinct from q.conv_id),
h as (select conv_id, sha256(coalesce(array_to_string(flatten(list(lines order by k)), chr(10)), '')) as repaired_sha256 from l group by conv_id)
select q.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, cost, audit, repaired_sha256
from q left join n on n.conv_id is not distinct from q.conv_id left join h on h.conv_id is not distinct from q.conv_id
"""
