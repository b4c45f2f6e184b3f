"""Conversation structure repair: the cheapest edits to legal turn orders, by a parallel Viterbi over chunks.

A conversation is legal when its role initials are (s?(ua)+)?. Rows are kept,
given the expected role, or deleted, and empty turns are inserted; the cheapest
edits are wanted, and of those the least in the order of their initials.

Rows are numbered over the whole table and cut into chunks of CHUNK, of which a
chunk holds one letter per row. The costs to go, a vector over the four states
of the grammar, run backwards. Every chunk but a conversation's last starts from
a speculative vector. Fix-up passes rerun the chunks whose right neighbour came
out differently, until all vectors differ from the ones used by constants only,
which add up to the cost; inside a chunk a rerun ends where it meets the earlier
one. The stitched costs then drive the trace from the left: a chunk that does
not begin its conversation maps each entry state to its exit state, the maps are
composed, and each chunk writes its edits from its true entry state. In the end
edits and rows meet in one sorted stream per partition.

So the largest groups are a chunk, and the summaries of one conversation's
chunks, which are a CHUNK-th of its rows; rows of one conversation stream
through one task in order, none is held.

Nulls in role and text are one space. Rows of a conversation go by turn, nulls
first; rows of one turn by a digest of role and text. Repeated rows are rows of
their own, all but the first of which are duplicates. A null conversation id is
an id like any other. A role counts by its first character; an empty role has
none and cannot be kept. Blank texts are empty or white space. Empty tables give
empty results. Columns beyond those named are not carried.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profseek.functions.shared import checkpointed
from profseek.operators.numbering import number_all

CHUNK = 4096
WHITE = " \t\n\x0b\x0c\r"
INITIALS = "sua"
SOUND, TRUNCATED, DOOMED = range(3)
#: One letter for each initial (or another one) and fault.
LETTERS = "abcdefghijkl"
#: By state (nothing yet, after s, after u, after a): where the role expected next leads, and that role.
NEXT, EXPECTED = (2, 2, 3, 2), ("user", "user", "assistant", "user")
RELABEL, DELETE, INSERT, LEFT_TRUNCATED = 1, 2, 5, 5


def _kept(state: int, initial: int) -> int | None:
    """The state after keeping a row of that initial, if the grammar lets it."""
    if initial == 0:
        return 1 if state == 0 else None
    if initial == 1:
        return 2 if state != 2 else None
    return 3 if initial == 2 and state == 2 else None


def _with_inserts(costs: list[int]) -> list[int]:
    """Costs to go when turns may be inserted first; more than two never help."""
    return [min(costs[s], INSERT + costs[NEXT[s]], 2 * INSERT + costs[NEXT[NEXT[s]]]) for s in range(4)]


def _written(costs: list[int]) -> tuple[str, int]:
    least = min(costs)
    return "".join(chr(48 + c - least) for c in costs), least


#: Costs to go after the last row: complete the last pair.
END = _written(_with_inserts([0, 99, 99, 0]))[0]


@functools.cache
def _options(letter: str, after: str) -> tuple[tuple[tuple[int, str, int], ...], ...]:
    """For each state the edits of a row (cost to go, initial, next state), without inserts."""
    fault, initial = divmod(LETTERS.index(letter), 4)
    costs = [ord(c) - 48 for c in after]
    found = []
    for state in range(4):
        edits = [(DELETE + costs[state], "D", state)]
        if fault != DOOMED:
            extra = LEFT_TRUNCATED if fault == TRUNCATED else 0
            to = _kept(state, initial)
            if to is not None:
                edits.append((extra + costs[to], "K", to))
            edits.append((extra + RELABEL + costs[NEXT[state]], "R", NEXT[state]))
        found.append(tuple(edits))
    return tuple(found)


@functools.cache
def _step(letter: str, after: str) -> tuple[str, int]:
    """The vector before a row from the one after it, and the constant between them."""
    return _written(_with_inserts([min(c for c, _, _ in edits) for edits in _options(letter, after)]))


@functools.cache
def _traced(letter: str, after: str, state: int) -> tuple[str, int]:
    """Least edits up to and with a row, and the next state."""
    options = _options(letter, after)
    costs = _with_inserts([min(c for c, _, _ in edits) for edits in options])
    done = ""
    while True:
        choices = [(e, to, False) for cost, e, to in options[state] if cost == costs[state]]
        if INSERT + costs[NEXT[state]] == costs[state]:
            choices.append(("I", NEXT[state], True))
        edit, state, again = min(choices)
        done += edit
        if not again:
            return done, state


def _backwards(codes: str, vector: str) -> tuple[str, int]:
    total = 0
    for letter in reversed(codes):
        vector, more = _step(letter, vector)
        total += more
    return vector, total


def _fixed(codes: str, old: str, new: str) -> tuple[str | None, int]:
    """Rerun beside the earlier run until they agree: the new vector, None if the old one stands, and the change of cost."""
    change = 0
    for letter in reversed(codes):
        if old == new:
            return None, change
        old, less = _step(letter, old)
        new, more = _step(letter, new)
        change += more - less
    return new, change


def _edits(codes: str, vector: str, state: int, last: bool) -> tuple[str, int]:
    """Edits of a chunk from an entry state, and the exit state."""
    after = [vector]
    for letter in reversed(codes):
        after.append(_step(letter, after[-1])[0])
    done = []
    for i, letter in enumerate(codes):
        edits, state = _traced(letter, after[len(codes) - 1 - i], state)
        done.append(edits)
    while last and state in (1, 2):
        done.append("I")
        state = NEXT[state]
    return "".join(done), state


def _mapped(df: DataFrame, one, schema: str) -> DataFrame:
    """`one` of every row, as a tuple of the columns of the schema that follow those of `df`."""
    from pyspark.sql.types import StructType

    kept = list(df.columns)
    full = StructType([*df.schema.fields, *StructType.fromDDL(schema).fields])
    names, kinds = full.names[len(kept):], [f.dataType for f in full.fields[len(kept):]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            made = [one(row) for row in batch.to_pylist()]
            new = [pa.array([m[k] for m in made], to_arrow_type(kind)) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*kept, *names])

    return df.mapInArrow(work, full)


def _rows(df: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    role, text = F.coalesce(df[role].cast("string"), F.lit(" ")), F.coalesce(df[text].cast("string"), F.lit(" "))
    named = df.select(F.struct(df[conversation].alias("id")).alias("chat"), df[turn].alias("turn"), role.alias("role"),
                      text.alias("text"))
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    return named.withColumn("said", said)


def _coded(rows: DataFrame) -> DataFrame:
    """Narrow rows in their order, with the first fault of each and its letter."""
    trimmed = F.rtrim("text", F.lit(WHITE))
    narrow = rows.select(
        "chat", "turn", "said", (trimmed == "").alias("blank"),
        (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
        F.coalesce(F.nullif(F.instr(F.lit(INITIALS), F.substring("role", 1, 1)), F.lit(0)), F.lit(4)).alias("initial"),
        (F.length("role") > 0).alias("named"))
    numbered = checkpointed(number_all(narrow, "chat", "turn", "said", name="ordinal"))
    again = numbered.groupBy("chat", "said").agg(F.min("ordinal").alias("first"), F.count(F.lit(1)).alias("n")).filter(
        "n > 1").select("chat", "said", "first")
    known = numbered.join(again, ["chat", "said"], "left")
    duplicate = F.coalesce(F.col("ordinal") > F.col("first"), F.lit(False))
    fault = F.when(F.col("blank"), "blank").when(duplicate, "duplicate").when(F.col("truncated"), "truncated")
    initial = F.when(F.col("named"), F.col("initial") - 1).otherwise(3)
    code = initial + 4 * F.when(fault == "truncated", TRUNCATED).when(fault.isNotNull(), DOOMED).otherwise(SOUND)
    return checkpointed(known.select("chat", "turn", "said", "ordinal", fault.alias("fault"),
                                     F.substring(F.lit(LETTERS), code + 1, F.lit(1)).alias("letter")))


def _chunks(coded: DataFrame) -> DataFrame:
    """(chat, chunk, turn, said of its first row, codes)."""
    chunk = F.floor(F.col("ordinal") / CHUNK).cast("long")
    grouped = coded.groupBy("chat", chunk.alias("chunk")).agg(
        F.min(F.struct("ordinal", "turn", "said")).alias("head"),
        F.sort_array(F.collect_list(F.struct("ordinal", "letter"))).alias("rows"))
    return grouped.select("chat", "chunk", F.col("head.turn").alias("turn"), F.col("head.said").alias("said"),
                          F.array_join(F.transform("rows", lambda r: r["letter"]), "").alias("codes"))


def _stitched(chunks: DataFrame) -> DataFrame:
    """`chunks` with the vector after each, the one before it and the constant between, fixed up over borders."""
    runs = checkpointed(_mapped(chunks.withColumn("after", F.lit(END)), lambda r: _backwards(r["codes"], r["after"]),
                                "before string, cost long"))
    several = runs.groupBy("chat").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("chat")
    alone, parted = runs.join(several, "chat", "left_anti"), checkpointed(runs.join(several, "chat", "left_semi"))
    while True:
        right = parted.select("chat", (F.col("chunk") - 1).alias("chunk"), F.col("before").alias("wanted"))
        stale = checkpointed(parted.join(right, ["chat", "chunk"]).filter("wanted <> after"))
        if stale.isEmpty():
            break

        def rerun(r: dict) -> tuple[str, int]:
            vector, change = _fixed(r["codes"], r["after"], r["wanted"])
            return vector or r["before"], r["cost"] + change

        fixed = _mapped(stale, rerun, "vector string, total long").select(
            "chat", "chunk", "turn", "said", "codes", F.col("wanted").alias("after"), F.col("vector").alias("before"),
            F.col("total").alias("cost"))
        parted = checkpointed(parted.join(stale.select("chat", "chunk"), ["chat", "chunk"], "left_anti")
                              .unionByName(fixed))
    exits = _mapped(parted, lambda r: ([_edits(r["codes"], r["after"], s, False)[1] for s in range(4)],),
                    "exits array<int>")
    lists = exits.groupBy("chat").agg(F.sort_array(F.collect_list(F.struct("chunk", "exits"))).alias("parts"))
    start = F.struct(F.lit(0).alias("state"), F.array().cast("array<struct<chunk:bigint,entry:int>>").alias("found"))
    walked = F.aggregate("parts", start, lambda at, part: F.struct(
        F.get(part["exits"], at["state"]).alias("state"),
        F.concat(at["found"], F.array(F.struct(part["chunk"].alias("chunk"), at["state"].alias("entry")))).alias("found")))
    entries = lists.select("chat", F.inline(walked["found"])).join(
        parted.groupBy("chat").agg(F.max("chunk").alias("last")), "chat")
    return alone.select("*", F.lit(0).alias("entry"), F.lit(True).alias("ends")).unionByName(
        parted.join(entries, ["chat", "chunk"]).withColumn("ends", F.col("chunk") == F.col("last")).drop("last"))


def _illegal(codes: str) -> int:
    shown = [LETTERS.index(c) % 4 for c in codes]
    return sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(shown, shown[1:]))


class Repair:
    """Faults, cheapest edits and repaired rows of the conversations of a table."""

    def __init__(self, df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> None:
        self._texts = _rows(df, conversation, turn, role, text)
        self._coded = _coded(self._texts)
        self._traced = checkpointed(_mapped(
            _stitched(_chunks(self._coded)),
            lambda r: (_edits(r["codes"], r["after"], r["entry"], r["ends"])[0], _illegal(r["codes"])),
            "audit string, illegal long"))

    def report(self) -> DataFrame:
        """(id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation with rows."""
        count = lambda kind: F.count(F.when(F.col("fault") == kind, True)).alias(kind)
        faults = self._coded.groupBy("chat").agg(
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
            count("blank"), count("duplicate"), count("truncated"))
        part = F.struct("chunk", "audit", "illegal", "cost", F.left("codes", F.lit(1)).alias("head"),
                        F.right("codes", F.lit(1)).alias("tail"), "before")
        parts = self._traced.groupBy("chat").agg(F.sort_array(F.collect_list(part)).alias("parts"))
        initial = lambda letter: (F.instr(F.lit(LETTERS), letter) - 1) % 4
        pairs = F.zip_with(F.slice("parts", 1, F.size("parts") - 1), F.slice("parts", 2, F.size("parts")),
                           lambda a, b: F.concat(initial(a["tail"]).cast("string"), initial(b["head"]).cast("string")))
        between = F.size(F.filter(pairs, lambda p: ~p.isin("01", "12", "21")))
        total = lambda name: F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + p[name])
        edits = parts.select(
            "chat", (total("illegal") + between).alias("illegal"),
            (total("cost") + F.ascii(F.get("parts", F.lit(0))["before"]) - 48).alias("cost"),
            F.array_join(F.transform("parts", lambda p: p["audit"]), "").alias("audit"))
        return faults.join(edits, "chat").select(F.col("chat.id").alias("id"), "gaps", "blank", "duplicate", "truncated",
                                                 "illegal", "cost", "audit")

    def rows(self) -> DataFrame:
        """Repaired rows (id, place, role, text): those of a conversation in one partition, in order."""
        heads = self._traced.select("chat", "turn", "said", F.lit(0).alias("kind"), "chunk", F.lit(None).cast("string")
                                    .alias("role"), F.lit(None).cast("string").alias("text"), "audit", "ends")
        texts = self._texts.select("chat", "turn", "said", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("chunk"),
                                   "role", "text", F.lit(None).cast("string").alias("audit"), F.lit(False).alias("ends"))
        both = heads.unionByName(texts).repartition("chat").sortWithinPartitions("chat", "turn", "said", "kind", "chunk")
        kind = self._texts.schema["chat"].dataType.fields[0].dataType.simpleString()
        return both.selectExpr("chat.id AS id", "kind", "role", "text", "audit", "ends").mapInArrow(
            _repaired, f"id {kind}, place long, role string, text string")


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits and rows of a sorted stream to repaired rows; edits come before the first row that needs them."""
    edits, at, state, place, left, ends, new = "", 0, 0, 0, 0, False, True
    for batch in batches:
        out: list[tuple] = []

        def put(chat, role: str, text: str) -> None:
            nonlocal place
            out.append((chat, place, role, text))
            place += 1

        for r in batch.to_pylist():
            if r["kind"] == 0:
                if new:
                    edits, at, state, place, left, ends, new = "", 0, 0, 0, 0, False, False
                edits, at, ends = edits[at:] + r["audit"], 0, ends or r["ends"]
                left += len(r["audit"]) - r["audit"].count("I")  # rows that those edits are for
            else:
                while edits[at] == "I":
                    put(r["id"], EXPECTED[state], "")
                    state, at = NEXT[state], at + 1
                if edits[at] == "K":
                    put(r["id"], r["role"], r["text"])
                    state = _kept(state, INITIALS.index(r["role"][0]))
                elif edits[at] == "R":
                    put(r["id"], EXPECTED[state], r["text"])
                    state = NEXT[state]
                at, left = at + 1, left - 1
            if ends and left == 0:  # only turns to complete
                for _ in edits[at:]:
                    put(r["id"], EXPECTED[state], "")
                    state = NEXT[state]
                new = True
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[0] for o in out], batch.schema.field("id").type), pa.array([o[1] for o in out], pa.int64()),
             pa.array([o[2] for o in out], pa.string()), pa.array([o[3] for o in out], pa.string())],
            ["id", "place", "role", "text"])


def digests(rows: DataFrame) -> DataFrame:
    """(id, digest) of `Repair.rows()`: SHA-256 of role:text lines, read as a stream within each partition."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running, chat, kind = None, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([chat], kind), pa.array([running.hexdigest()])], ["id", "digest"])

        for batch in batches:
            kind = batch.schema.field("id").type
            for r in batch.to_pylist():
                if r["place"] == 0:
                    if running:
                        yield done()
                    running, chat = hashlib.sha256(), r["id"]
                else:
                    running.update(b"\n")
                running.update(f"{r['role']}:{r['text']}".encode())
        if running:
            yield done()

    return rows.mapInArrow(work, f"id {rows.schema['id'].dataType.simpleString()}, digest string")


def damaged(df: DataFrame) -> DataFrame:
    """Test damage to (conv_id, turn, role, text) by a checksum of id and turn: lost, emptied, cut, repeated, misnamed rows."""
    space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = df.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).filter(
        "kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def empty_digest() -> Column:
    return F.sha2(F.lit(""), 256)
