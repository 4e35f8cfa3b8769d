"""Repair of the structure of conversations: the cheapest edits of roles and turns, over a grammar of their sequences.

Rows become symbols: the initial of the role (``s``, ``u``, ``a``, or ``o`` for any other), a capital for a truncated row, ``D`` for one that
must go. What a stretch of symbols costs is a matrix: for each state before and after, the cheapest edits, with their
audit. Matrices multiply by minimum and sum, ties going to the audit that is least in ASCII. (Audits of equal cost over the same rows
are never one the beginning of the other, as a further insertion costs more; so the least of two parts is the least of the whole.)

Frequent neighbouring symbols are replaced by new ones, again and again, as in Re-Pair, over the distinct sequences of all
conversations: counts are made by Spark, and a round takes several pairs that have no symbol in common, whose counts do not touch
each other. Each rule's matrix comes from those of its two parts and is shared by all conversations; audits are ropes, which share their parts.

A conversation may hold most rows: rows are sorted over all tasks and cut into segments of bounded size, whose matrices follow from the
grammar. Only segments of conversations that a task does not hold as a whole meet again, in order, as symbols without their texts; at last
the lines of such a conversation pass through SHA-256 in order, one segment at a time, which is the one step that cannot be divided.

Defined results: nulls in roles and texts count as one space, in the key of the damage too; a null ``conv_id`` is one conversation. Rows are
taken by turn, nulls first, then by role and the digest of the text; equal rows are copies of each other. Conversations without rows after the
damage have zeros, an empty audit and the digest of the empty text. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papersheaf.llm.tables import measured
from papersheaf.operators.blocks import arrow_schema
from papersheaf.session import discard, materialized

SPACES = " \t\n\x0b\x0c\r"
ENDS = ".!?"
SEGMENT_ROWS, SEGMENT_CHARS = 2048, 1 << 20
ROUNDS, RULES, CANDIDATES = 16, 512, 64
REMEMBERED = 1 << 13  # sequences of a task, of at most FLAT symbols
FIRST_RULE = 0xE000  # symbols of rules are characters of the private area
LEGAL = {"su", "ua", "au"}
NAMES = {"u": "user", "a": "assistant"}
START, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (START, ASSISTANT)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

# --- ropes: strings, or pairs of ropes with their length ---

Rope = str | tuple
FLAT = 64


def length(rope: Rope) -> int:
    return len(rope) if isinstance(rope, str) else rope[2]


def concat(a: Rope, b: Rope) -> Rope:
    if not length(a) or not length(b):
        return b if not length(a) else a
    size = length(a) + length(b)
    return flat(a) + flat(b) if size <= FLAT else (a, b, size)


def leaves(rope: Rope) -> Iterator[str]:
    stack = [rope]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            yield top
        else:
            stack += [top[1], top[0]]


def flat(rope: Rope) -> str:
    return rope if isinstance(rope, str) else "".join(leaves(rope))


def less(a: Rope, b: Rope) -> bool:
    """Whether ``a`` comes before ``b``; parts that both share are passed over."""
    left, right = [a], [b]
    while left and right:
        x, y = left.pop(), right.pop()
        if x is y:
            continue
        if isinstance(x, str) and isinstance(y, str):
            common = min(len(x), len(y))
            if x[:common] != y[:common]:
                return x[:common] < y[:common]
            if len(x) > common:
                left.append(x[common:])
            if len(y) > common:
                right.append(y[common:])
        elif isinstance(y, str) or (not isinstance(x, str) and length(x) >= length(y)):
            left += [x[1], x[0]]
            right.append(y)
        else:
            right += [y[1], y[0]]
            left.append(x)
    return not left and bool(right)


# --- matrices: {(state before, state after): (cost, audit)} ---

Matrix = dict[tuple[int, int], tuple[int, Rope]]


def put(found: dict, place, cost: int, audit: Rope) -> bool:
    """Keeps the cheaper, and of equal ones the one with the lesser audit; whether it is the new one."""
    known = found.get(place)
    if known is None or cost < known[0] or (cost == known[0] and less(audit, known[1])):
        found[place] = (cost, audit)
        return True
    return False


def product(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = {}
    for (i, k), (cost, audit) in a.items():
        for j in range(4):
            if (k, j) in b:
                more = b[k, j]
                known = out.get((i, j))
                if known is None or cost + more[0] <= known[0]:
                    put(out, (i, j), cost + more[0], concat(audit, more[1]))
    return out


def insertions() -> Matrix:
    """No, one or two inserted turns; more would come back to a state at a price."""
    out: Matrix = {(state, state): (0, "") for state in range(4)}
    for state in range(4):
        at, audit = state, ""
        for _ in range(2):
            at = USER if at != USER else ASSISTANT
            audit += "I"
            put(out, (state, at), INSERT * len(audit), audit)
    return out


INSERTED = insertions()


def terminal(symbol: str) -> Matrix:
    """Insertions, then one row."""
    row: Matrix = {(state, state): (DELETE, "D") for state in range(4)}
    if symbol != "D":
        extra = TRUNCATED if symbol.isupper() else 0
        for state in range(4):
            if (after := STEP.get((state, symbol.lower()))) is not None:
                put(row, (state, after), KEEP + extra, "K")
            put(row, (state, ASSISTANT if state == USER else USER), REROLE + extra, "R")
    return product(INSERTED, row)


@dataclass
class Grammar:
    """Rules in the order they were made: rule ``k`` replaces a pair of symbols by the character ``FIRST_RULE + k``."""

    pairs: list[str]
    matrices: dict[str, Matrix] = field(default_factory=dict)
    known: dict[str, Matrix] = field(default_factory=dict)

    def compressed(self, sequence: str) -> str:
        for k, pair in enumerate(self.pairs):
            if pair in sequence:
                sequence = sequence.replace(pair, chr(FIRST_RULE + k))
        return sequence

    def prepare(self) -> Grammar:
        """Bottom-up: the matrix of each rule from those of its two symbols."""
        if not self.matrices:
            self.matrices = {symbol: terminal(symbol) for symbol in "suaoSUAOD"}
            for k, pair in enumerate(self.pairs):
                self.matrices[chr(FIRST_RULE + k)] = product(self.matrices[pair[0]], self.matrices[pair[1]])
        return self

    def matrix(self, sequence: str) -> Matrix:
        """The matrix of a sequence, remembered in a task for the next conversation like it."""
        found = self.known.get(sequence)
        if found is None:
            found = {(state, state): (0, "") for state in range(4)}
            for symbol in self.compressed(sequence):
                found = product(found, self.matrices[symbol])
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            if len(sequence) <= FLAT:
                self.known[sequence] = found
        return found


def pair_counts(sequence: str) -> Counter:
    """How often each pair of neighbours can be replaced."""
    counts: Counter = Counter()
    run = 0
    for a, b in zip(sequence, sequence[1:]):
        run = run + 1 if a == b else 0
        if a != b or run % 2:
            counts[a + b] += 1
    return counts


def learn(sequences: DataFrame, rounds: int = ROUNDS, rules: int = RULES) -> Grammar:
    """The grammar of a written table ``(seq, n)`` of distinct sequences: of each round at most ``CANDIDATES`` pairs reach the driver."""
    out = arrow_schema(sequences, "pair string, n bigint")
    pairs: list[str] = []
    for _ in range(rounds):
        grammar = Grammar(list(pairs))

        def run(batches: Iterator[pa.RecordBatch], grammar=grammar) -> Iterator[pa.RecordBatch]:
            total: Counter = Counter()
            for batch in batches:
                for sequence, n in zip(batch.column("seq").to_pylist(), batch.column("n").to_pylist()):
                    for pair, times in pair_counts(grammar.compressed(sequence)).items():
                        total[pair] += times * n
            yield from pa.table([list(total), list(total.values())], schema=out).to_batches()

        counted = sequences.mapInArrow(run, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).filter("n > 1")
        taken: set[str] = set()
        before = len(pairs)
        for row in counted.orderBy(F.desc("n"), "pair").limit(CANDIDATES).collect():
            if not taken & set(row.pair) and len(pairs) < rules:
                pairs.append(row.pair)
                taken |= set(row.pair)
        if len(pairs) == before:
            break
    return Grammar(pairs)


# --- rows ---


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch as Python values, a few at a time."""
    for start in range(0, batch.num_rows, 64):
        yield from batch.slice(start, 64).to_pylist()


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, copies)``: rows after the damage that the CRC of their key decides."""
    one = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), one), F.lit(":"), F.coalesce(F.col("turn").cast("string"), one))
    kind = F.crc32(key) % 20
    text = F.coalesce("text", one)
    changed = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, f"[{ENDS}]", "")).otherwise(text)
    return conversations.filter(kind != 0).select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce("role", one)).alias("role"),
        changed.alias("text"),
        F.when(kind == 3, F.lit(2)).otherwise(F.lit(1)).cast("bigint").alias("copies"),
    )


def lost(conversations: DataFrame) -> DataFrame:
    """``conv_id`` of the conversations that the damage leaves without rows."""
    left = damaged(conversations).select("conv_id", F.lit(1).alias("rows"))
    every = conversations.select("conv_id", F.lit(0).alias("rows"))
    return every.unionByName(left).groupBy("conv_id").agg(F.max("rows").alias("rows")).filter("rows = 0").select("conv_id")


def _order() -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "digest")]


def ordered(rows: DataFrame) -> DataFrame:
    """Rows in order over all tasks, equal ones as one with their number, and whether role and text were seen in an earlier turn.

    Only rows whose role and text occur again in their conversation are grouped, by partial counts, so copies shrink where they lie.
    """
    digest = F.unhex(F.sha2("text", 256))
    named = rows.withColumn("digest", digest)
    again = named.groupBy("conv_id", "role", "digest").agg(
        F.count("*").alias("k"), F.min("turn").alias("first_turn"), F.bool_or(F.col("turn").isNull()).alias("first_null")
    )
    again = materialized(again.filter("k > 1").select(*(F.col(c).alias(f"_{c}") for c in ("conv_id", "role", "digest")), "first_turn", "first_null"))
    same = named["conv_id"].eqNullSafe(F.col("_conv_id")) & (F.col("_role") == named["role"]) & (F.col("_digest") == named["digest"])
    joined = named.join(measured(again, 96), same, "left").drop("_conv_id", "_role")
    alone = joined.filter("_digest is null").select(*named.columns, F.lit(False).alias("seen"))
    first = F.when(F.col("first_null"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("first_turn"))
    several = (
        joined.filter("_digest is not null").select(*named.columns, (~first).alias("seen"))
        .groupBy("conv_id", "turn", "role", "text", "digest", "seen").agg(F.sum("copies").alias("copies"))
    )
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    both = alone.unionByName(several).select(
        "conv_id", "turn", "role", "text", "copies", "digest", "seen", (end == "").alias("blank"),
        (~F.right(end, F.lit(1)).isin(*ENDS)).alias("truncated"),
    )
    return both.repartitionByRange(*_order()).sortWithinPartitions(*_order()).drop("digest")


@dataclass
class Segment:
    """Rows of one conversation that follow each other: symbols, counts, and roles and texts of those that may stay."""

    conv_id: object
    seq: list[str] = field(default_factory=list)
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    size: int = 0
    chars: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first: str = ""
    last: str | None = None
    low: int | None = None
    high: int | None = None
    turns: int = 0

    def initial(self, initial: str, n: int) -> None:
        if self.last is None:
            self.first = initial
        elif self.last + initial not in LEGAL:
            self.illegal += 1
        self.illegal += n - 1  # a role twice in a row
        self.last = initial

    def turn(self, turn: int | None) -> None:
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn

    def add(self, turn: int | None, role: str, text: str, fault: str, n: int, first: bool) -> None:
        """``n`` copies of a row, of which the first has ``fault`` unless an earlier segment has it."""
        self.turn(turn)
        self.initial(role[:1], n)
        gone = n if fault in ("blank", "duplicate") or not first else n - 1
        if fault == "blank":
            self.blank += gone
        else:
            self.duplicate += gone
        if gone < n:
            symbol = role[:1] if role[:1] in ("s", "u", "a") else "o"
            self.truncated += fault == "truncated"
            self.seq.append(symbol.upper() if fault else symbol)
            self.roles.append(role)
            self.texts.append(text)
            self.chars += len(text) + len(role)
        self.seq.append("D" * gone)
        self.size += n


STATS = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, low bigint, high bigint, turns bigint"
STAT_NAMES = [part.split()[0] for part in STATS.split(", ")]


def _segment_columns(id_type: str) -> str:
    return f"conv_id {id_type}, seg bigint, whole boolean, seq string, {STATS}, roles array<string>, texts array<string>"


def segments(rows: DataFrame, segment_rows: int = SEGMENT_ROWS, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """The rows of ``ordered`` as segments, numbered in order; ``whole`` tells that one is all of its conversation."""
    schema = _segment_columns(rows.schema["conv_id"].dataType.simpleString())
    out = arrow_schema(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, pending = TaskContext.get().partitionId() << 40, []
        current: Segment | None = None
        parts, conversations = 0, 0  # segments of this conversation so far; conversations so far

        def done(ends: bool) -> None:
            nonlocal number, parts
            # the first and the last conversation of a task may go on in its neighbours
            whole = ends and parts == 0 and conversations > 1
            made = {name: getattr(current, name) for name in ("conv_id", *STAT_NAMES, "roles", "texts")}
            pending.append(made | {"seg": number, "whole": whole, "seq": "".join(current.seq)})
            number, parts = number + 1, parts + 1

        for batch in batches:
            for row in rows_of(batch):
                if current is None or row["conv_id"] != current.conv_id:
                    if current is not None:
                        done(True)
                    current, parts, conversations = Segment(row["conv_id"]), 0, conversations + 1
                left, first = row["copies"], True
                fault = "blank" if row["blank"] else "duplicate" if row["seen"] else "truncated" if row["truncated"] else ""
                while left:
                    if current.size >= segment_rows or current.chars >= segment_chars:
                        done(False)
                        current = Segment(row["conv_id"])
                    n = min(left, segment_rows - current.size)
                    current.add(row["turn"], row["role"], row["text"], fault, n, first)
                    left, first = left - n, False
            yield from pa.Table.from_pylist(pending, schema=out).to_batches()
            pending.clear()
        if current is not None:
            done(False)
            yield from pa.Table.from_pylist(pending, schema=out).to_batches()

    return rows.mapInArrow(run, schema)


# --- repair ---


def lines(seq: str, roles: list[str], texts: list[str], state: int, audit: str) -> list[str]:
    """The rows that an audit leaves of a segment, entered in ``state``, as ``role:text``."""
    out, at, row = [], 0, 0
    for edit in audit:
        if edit != "I":
            symbol = seq[at]
            at += 1
            if symbol != "D":
                role, text = roles[row], texts[row]
                row += 1
            if edit == "D":
                continue
        if edit == "K":
            out.append(f"{role}:{text}")
            state = STEP[state, symbol.lower()]
            continue
        state = ASSISTANT if state == USER else USER
        out.append(f"{NAMES['a' if state == ASSISTANT else 'u']}:{'' if edit == 'I' else text}")
    return out


def finished(vector: dict[int, tuple[int, Rope]]) -> tuple[int, Rope, int, str]:
    """The cheapest end of a conversation: cost, audit, the state before the last insertions, and these."""
    best: dict = {}
    chosen = (START, "")
    for state, (cost, audit) in sorted(vector.items()):
        for end in FINAL:
            if (state, end) in INSERTED:
                more, inserted = INSERTED[state, end]
                if put(best, "end", cost + more, concat(audit, inserted)):
                    chosen = state, inserted
    return *best["end"], *chosen


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else high - low + 1 - turns


def _whole(found: DataFrame, grammar: Grammar, id_type: str) -> DataFrame:
    """Conversations that are one segment: all of the repair in place."""
    schema = f"conv_id {id_type}, {RESULT}, repaired_sha256 string"
    out = arrow_schema(found, schema)
    shared = found.sparkSession.sparkContext.broadcast(grammar)  # at most RULES pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = shared.value.prepare()
        for batch in batches:
            rows = []
            for row in rows_of(batch):
                matrix = rules.matrix(row["seq"])
                cost, audit, _, _ = finished({j: entry for (i, j), entry in matrix.items() if i == START})
                audit = flat(audit)
                kept = lines(row["seq"], row["roles"], row["texts"], START, audit)
                row |= {"gaps": _gaps(row["low"], row["high"], row["turns"]), "cost": cost, "audit": audit}
                rows.append({name: row[name] for name in out.names[:-1]} | {"repaired_sha256": _digest("\n".join(kept))})
            yield from pa.Table.from_pylist(rows, schema=out).to_batches()

    return found.mapInArrow(run, schema)


@dataclass
class Conversation:
    """A conversation whose segments come one after the other: counts, and the cheapest way to each state."""

    conv_id: object
    head: int
    vector: dict = field(default_factory=lambda: {START: (0, "")})
    ways: list = field(default_factory=list)  # of each segment: its number and, by state after it, state before it and audit
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    last: str | None = None
    low: int | None = None
    high: int | None = None
    turns: int = 0

    def add(self, row: dict, matrix: Matrix) -> None:
        for name in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + row[name])
        self.illegal += self.last is not None and self.last + row["first"] not in LEGAL
        self.last = row["last"]
        if row["low"] is not None:
            self.turns += row["turns"] - (self.high == row["low"])
            self.low = row["low"] if self.low is None else self.low
            self.high = row["high"]
        found: dict = {}
        way: dict = {}
        for (i, j), (cost, audit) in sorted(matrix.items(), key=lambda entry: entry[0]):
            if i in self.vector and put(found, j, self.vector[i][0] + cost, concat(self.vector[i][1], audit)):
                way[j] = (i, audit)
        self.vector = found
        self.ways.append((row["seg"], way))

    def rows(self) -> Iterator[dict]:
        """The audit of each segment from the last to the first, then the totals."""
        cost, audit, state, inserted = finished(self.vector)
        for seg, way in reversed(self.ways):
            state, part = way[state]
            yield {"head": self.head, "seg": seg, "state": state, "audit": flat(part) + inserted}
            inserted = ""
        names = ("conv_id", "head", "blank", "duplicate", "truncated", "illegal")
        totals = {name: getattr(self, name) for name in names}
        yield totals | {"gaps": _gaps(self.low, self.high, self.turns), "cost": cost, "audit": flat(audit)}


def _in_order(rows: DataFrame, *keys: str) -> DataFrame:
    """All rows of a key in one task, in order of their segments; a task takes them one by one."""
    return rows.repartition(keys[0]).sortWithinPartitions(*(F.col(key).asc_nulls_first() for key in keys))


def _divided(found: DataFrame, grammar: Grammar, id_type: str) -> DataFrame:
    """Conversations of several segments: matrices in order first, then texts by segment, then digests in order."""
    plan_schema = f"conv_id {id_type}, head bigint, seg bigint, state int, {RESULT}"
    plan_out = arrow_schema(found, plan_schema)
    shared = found.sparkSession.sparkContext.broadcast(grammar)  # at most RULES pairs

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = shared.value.prepare()
        current: Conversation | None = None
        for batch in batches:
            for row in rows_of(batch):
                if current is None or row["conv_id"] != current.conv_id:
                    if current is not None:
                        yield from written(current)
                    current = Conversation(row["conv_id"], row["seg"])
                current.add(row, rules.matrix(row["seq"]))
        if current is not None:
            yield from written(current)

    def written(conversation: Conversation) -> Iterator[pa.RecordBatch]:
        rows = []
        for row in conversation.rows():
            rows.append(row)
            if len(rows) == 256:
                yield from pa.Table.from_pylist(rows, schema=plan_out).to_batches()
                rows = []
        yield from pa.Table.from_pylist(rows, schema=plan_out).to_batches()

    symbols = found.drop("whole", "roles", "texts")
    plans = materialized(_in_order(symbols, "conv_id", "seg").mapInArrow(plan, plan_schema))
    line_out = arrow_schema(found, "head bigint, seg bigint, n bigint, body string")

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                kept = lines(row["seq"], row["roles"], row["texts"], row["state"], row["audit"])
                yield from pa.table([[row["head"]], [row["seg"]], [len(kept)], ["\n".join(kept)]], schema=line_out).to_batches()

    edits = plans.filter("seg is not null").select("seg", "head", "state", "audit")
    texts = found.select("seg", "seq", "roles", "texts").join(edits, "seg")
    bodies = texts.mapInArrow(replay, "head bigint, seg bigint, n bigint, body string").filter("n > 0")
    hash_out = arrow_schema(found, "head bigint, repaired_sha256 string")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, state = None, None
        for batch in batches:
            for row in rows_of(batch):
                if row["head"] != head:
                    if head is not None:
                        yield from pa.table([[head], [state.hexdigest()]], schema=hash_out).to_batches()
                    head, state = row["head"], hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(row["body"].encode())
        if head is not None:
            yield from pa.table([[head], [state.hexdigest()]], schema=hash_out).to_batches()

    hashes = _in_order(bodies, "head", "seg").mapInArrow(digest, "head bigint, repaired_sha256 string")
    totals = plans.filter("seg is null").join(hashes, "head", "left")
    names = [part.split()[0] for part in RESULT.split(", ")]
    return totals.select("conv_id", *names, F.coalesce("repaired_sha256", F.lit(_digest(""))).alias("repaired_sha256"))


def repair(conversations: DataFrame, segment_rows: int = SEGMENT_ROWS, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` for each conversation after the damage."""
    id_type = conversations.schema["conv_id"].dataType.simpleString()
    found = materialized(segments(ordered(damaged(conversations)), segment_rows, segment_chars))
    sequences = materialized(found.groupBy("seq").agg(F.count("*").alias("n")))
    grammar = learn(sequences)
    discard(sequences)
    names = [part.split()[0] for part in RESULT.split(", ")]
    none = lost(conversations).select(
        "conv_id", *(F.lit("" if name == "audit" else 0).alias(name) for name in names), F.lit(_digest("")).alias("repaired_sha256")
    )
    whole = _whole(found.filter("whole"), grammar, id_type)
    return whole.unionByName(_divided(found.filter("not whole"), grammar, id_type)).unionByName(none)
