"""Cheapest edits that turn conversations into alternating turns, found once per distinct rest of a conversation.

A conversation becomes a signature: one letter per row for its role's initial (s, u, a, other) and its first fault (none,
truncated, duplicate, blank). A suffix-shared acyclic word graph (DAWG) holds the signatures of all conversations: read from
the end, signatures with an equal rest share the nodes of that rest. Each node has, for each state of the grammar
`(s?(ua)+)?`, the least cost to go and the first letter of the best audit from there. Edits that can follow in one state
have different letters, so the least letter among the cheapest edits is the ASCII-least audit and nodes need no texts.

In Spark the graph is made by a range sort of the reversed signatures: those with a common rest lie next to each other, so
a task keeps only the path of the last signature and makes each node once; a node whose signatures are dealt over several
tasks is made once in each. No task needs the whole graph, and equal signatures, however many, are spread by conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.session import materialize

#: Fixed: blanks, the ends of a whole text, the roles inserted, and the costs of edits and of a truncated row that stays.
BLANKS, ENDS = " \t\n\v\f\r", ".!?"
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States of the grammar: nothing yet, after s, after u, after a. NEEDED is the initial that an edit must give.
START, SYSTEM, USER, ASSISTANT = range(4)
NEEDED, AFTER = "uuau", {"u": USER, "a": ASSISTANT}
#: Letters of a signature: four faults for each initial.
INITIALS, FAULTS = "suao", ("", "truncated", "duplicate", "blank")
LETTERS = {(i, f): chr(ord("a") + 4 * x + y) for x, i in enumerate(INITIALS) for y, f in enumerate(FAULTS)}
MEANING = {letter: key for key, letter in LETTERS.items()}
TO_INITIALS = str.maketrans({letter: key[0] for letter, key in MEANING.items()})
#: Cost to go and first edit at the end of a signature, by state.
END = ((0, 2 * INSERT, INSERT, 0), ("", "I", "I", ""))


def node(letter: str, rest: tuple[tuple, tuple]) -> tuple[tuple, tuple]:
    """Cost to go and first edit in each state, before a row of `letter` and the node of the rest."""
    (initial, fault), costs = MEANING[letter], rest[0]
    best = []
    for state, needed in enumerate(NEEDED):
        edits = [(DELETE + costs[state], "D")]
        if fault in ("", "truncated"):
            stays = TRUNCATED if fault else 0
            edits.append((REROLE + stays + costs[AFTER[needed]], "R"))
            if initial == needed:
                edits.append((stays + costs[AFTER[needed]], "K"))
            elif initial == "s" and state == START:
                edits.append((stays + costs[SYSTEM], "K"))
        best.append(min(edits))
    # An insert leads to another state of the same node; more than two would only come back to a state.
    plain = list(best)
    for state, other in ((USER, ASSISTANT), (ASSISTANT, USER)):
        best[state] = min(plain[state], (INSERT + plain[other][0], "I"))
    for state in (START, SYSTEM):
        best[state] = min(plain[state], (INSERT + best[USER][0], "I"))
    return tuple(c for c, _ in best), tuple(e for _, e in best)


class SuffixGraph:
    """The path of the last signature from the end; `made` counts the nodes made so far."""

    def __init__(self):
        self.path, self.nodes, self.made = "", [END], 0

    def add(self, signature: str) -> None:
        """Make the nodes of a signature that it does not share with the one before."""
        path, shared = signature[::-1], 0
        if path != self.path:
            for a, b in zip(path, self.path, strict=False):
                if a != b:
                    break
                shared += 1
            del self.nodes[shared + 1 :]
            for letter in path[shared:]:
                self.nodes.append(node(letter, self.nodes[-1]))
            self.made += len(path) - shared
            self.path = path

    def best(self) -> tuple[int, str]:
        """Cost and audit of the last signature."""
        state, at, audit = START, len(self.path), []
        while edit := self.nodes[at][1][state]:
            audit.append(edit)
            if edit != "I":
                at -= 1
            if edit == "K" and MEANING[self.path[at]][0] == "s":
                state = SYSTEM
            elif edit != "D":
                state = AFTER[NEEDED[state]]
        return self.nodes[-1][0][START], "".join(audit)


def report(graph: SuffixGraph, signature: str) -> tuple[int, int, int, int, int, str]:
    """Numbers of blank, duplicate and truncated rows, of illegal neighbours, then cost and audit."""
    graph.add(signature)
    faults = {f: sum(signature.count(LETTERS[i, f]) for i in INITIALS) for f in FAULTS}
    initials = signature.translate(TO_INITIALS)
    legal = sum(map(initials.count, ("su", "ua", "au")))
    return faults["blank"], faults["duplicate"], faults["truncated"], max(0, len(signature) - 1) - legal, *graph.best()


def repaired(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The (role, text) pairs that the edits of `audit` make of a conversation's rows."""
    state = START
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit != "K":
            role = ROLES[NEEDED[state]]
        state = SYSTEM if role[:1] == "s" else AFTER[role[:1]]
        yield role, text


def _given(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    blank = F.lit(" ")
    given = rows.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), blank).alias("role"), F.coalesce(F.col(text), blank).alias("text")
    )
    return given.withColumn("sha", F.unhex(F.sha2("text", 256)))


def _rows(batches) -> Iterator[tuple]:
    """All rows one after the other; only one value of the last column is held as a Python object at a time."""
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns[:-1]), (v.as_py() for v in batch.columns[-1]), strict=True)


def _batches(rows: Iterator[tuple], kinds: list[tuple[str, pa.DataType]], size: int = 4096, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size; texts count by their length."""
    held, weight = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in held], kind) for n, (_, kind) in enumerate(kinds)], [name for name, _ in kinds])

    for row in rows:
        held.append(row)
        weight += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= size or weight >= most_bytes:
            yield batch()
            held, weight = [], 0
    yield batch()


def _kind(rows: DataFrame) -> str:
    kind = rows.schema["conv"].dataType.simpleString()
    if kind not in ("string", "bigint", "int"):
        raise TypeError(f"conversation ids are texts or whole numbers, not {kind}")
    return kind


ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}


def _fragments(rows: Iterator[tuple], part: int) -> Iterator[tuple]:
    """What a task has of each conversation: its part of the signature, least, greatest and number of turns."""
    for conv, held in groupby(rows, key=lambda r: r[0]):
        letters, low, high, turns = [], None, None, 0
        for _, turn, role, blank, cut, again, n in held:
            initial = role[0] if role and role[0] in "sua" else "o"
            copy = LETTERS[initial, "blank" if blank else "duplicate"]
            first = copy if blank or again else LETTERS[initial, "truncated" if cut else ""]
            letters.append(first + copy * (n - 1) if n else "")
            if n and turn is not None and turn != high:
                low, high, turns = turn if low is None else low, turn, turns + 1
        yield conv, part, low, high, turns, "".join(letters)


def _signatures(given: DataFrame, every: DataFrame) -> DataFrame:
    """(conv, signature, gaps) of all conversations of `every`.

    Equal rows of a turn are counted before the shuffle. Rows are then dealt by ranges of conversation, turn, role and hash,
    so a long conversation is read by many tasks, each of which gives one fragment.
    """
    text = F.rtrim("text", F.lit(BLANKS))
    judged = given.select("conv", "turn", "role", "sha", (text == "").alias("blank"), (~F.right(text, F.lit(1)).isin(*ENDS)).alias("cut"))
    counted = judged.groupBy("conv", "turn", "role", "sha", "blank", "cut").agg(F.count("*").alias("n"))
    there = every.select("conv", *[F.lit(None).cast(t).alias(c) for c, t in judged.dtypes[1:]], F.lit(0).cast("long").alias("n"))
    turns = materialize(counted.unionByName(there), "turns")
    # The first turn of what a conversation says more than once in the same role.
    said = turns.where("n > 0").groupBy(F.col("conv").alias("_conv"), F.col("role").alias("_role"), F.col("sha").alias("_sha"))
    first = said.agg(F.min(F.struct("turn")).alias("_first"), F.count("*").alias("_turns")).where("_turns > 1")
    same = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("sha") == F.col("_sha"))
    again = F.coalesce(F.struct("turn") > F.col("_first"), F.lit(False)).alias("again")
    marked = turns.join(first, same, "left").select("conv", "turn", "role", "blank", "cut", again, "n", "sha")
    order = ["conv", "turn", "role", "sha"]
    kinds = [("conv", ARROW[_kind(marked)]), ("part", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), ("letters", pa.string())]

    def fragments(batches):
        yield from _batches(_fragments(_rows(b.select(range(7)) for b in batches), TaskContext.get().partitionId()), kinds)

    found = marked.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        fragments, f"conv {_kind(marked)}, part long, low long, high long, turns long, letters string"
    )
    whole = found.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "low", "high", "turns", "letters"))).alias("parts"))
    known = F.filter("parts", lambda p: p.turns > 0)
    # A turn that two neighbouring fragments share was counted by both.
    shared = F.size(F.filter(F.arrays_zip(F.transform("k", lambda p: p.high).alias("high"), F.slice(F.transform("k", lambda p: p.low), 2, F.greatest(F.size("k"), F.lit(1))).alias("low")), lambda z: z.high == z.low))
    counted = F.aggregate("k", F.lit(0).cast("long"), lambda n, p: n + p.turns) - shared
    wide = lambda c: c.cast("decimal(38,0)")
    span = wide(F.element_at("k", -1).high) - wide(F.element_at("k", 1).low) + 1 - wide(counted)
    gaps = F.when(F.size("k") > 0, F.least(span, F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")).otherwise(F.lit(0).cast("long"))
    return whole.withColumn("k", known).select("conv", F.array_join(F.transform("parts", lambda p: p.letters), "").alias("signature"), gaps.alias("gaps"))


def repair_reports(
    rows: DataFrame, every: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit; written and reread.

    Rows are taken by turn, nulls first, then by role and by the hash of the text; equal rows follow each other. Null roles
    and texts count as one blank. Rows without a conversation id are one conversation. `every` may name, in its column of
    the same name, conversations to report besides those with rows: without rows all numbers are 0 and the audit is empty.
    A span of turns that passes a long gives the greatest long as gaps. Other columns are not read.
    """
    given = _given(rows, conv, turn, role, text)
    ids = given.select("conv") if every is None else given.select("conv").unionByName(every.select(F.col(conv).alias("conv")))
    signed = _signatures(given, ids.distinct())
    names = ["blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    kinds = [("conv", ARROW[_kind(signed)]), ("gaps", pa.int64()), *((n, pa.int64()) for n in names[:-1]), ("audit", pa.string())]

    def reports(batches):
        graph, last, found = SuffixGraph(), None, ()

        def walked():
            nonlocal last, found
            for held, gaps, signature in _rows(batches):
                if signature != last:
                    last, found = signature, report(graph, signature)
                yield held, gaps, *found

        yield from _batches(walked(), kinds)

    order = [F.reverse("signature"), F.col("conv")]
    dealt = signed.select("conv", "gaps", "signature").repartitionByRange(*order).sortWithinPartitions(*order)
    done = dealt.mapInArrow(reports, f"conv {_kind(signed)}, gaps long, {', '.join(f'{n} long' for n in names[:-1])}, audit string")
    return materialize(done.withColumnRenamed("conv", conv), "repairs")


def _replayed(rows: DataFrame, reports: DataFrame, edit, result: str, kinds, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Each conversation's audit, then its rows in order, as one stream; `edit` makes rows of (audit, rows).

    A conversation stays in one task, since its hash needs its rows in order, but it is never held: the sort spills to disk
    and the rows pass by one at a time.
    """
    given = _given(rows, conv, turn, role, text)
    heads = reports.select(F.col(conv).alias("conv"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("sha"), F.col("audit").alias("text"))
    stream = heads.unionByName(given.withColumn("kind", F.lit(1))).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "sha")
    kind = _kind(given)

    def replay(batches):
        def made():
            for held, group in groupby(_rows(batches), key=lambda r: r[0]):
                _, _, audit = next(group)
                for row in edit(repaired(audit, ((r, t) for _, r, t in group))):
                    yield held, *row

        yield from _batches(made(), [("conv", ARROW[kind]), *kinds])

    return stream.select("conv", "role", "text").mapInArrow(replay, f"conv {kind}, {result}").withColumnRenamed("conv", conv)


def repaired_rows(rows: DataFrame, reports: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, place, role, text) of the conversations of `reports` after their edits; places count from 0."""

    def numbered(pairs):
        return ((place, *pair) for place, pair in enumerate(pairs))

    return _replayed(rows, reports, numbered, "place long, role string, text string", [("place", pa.int64()), ("role", pa.string()), ("text", pa.string())], conv, turn, role, text)


def repaired_hashes(rows: DataFrame, reports: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, sha256) of the repaired `role:text` lines, of all conversations of `reports`; without rows, of no text."""

    def hashed(pairs):
        digest, between = hashlib.sha256(), b""
        for one, said in pairs:
            digest.update(between + f"{one}:{said}".encode())
            between = b"\n"
        yield (digest.hexdigest(),)

    return _replayed(rows, reports, hashed, "sha256 string", [("sha256", pa.string())], conv, turn, role, text)
