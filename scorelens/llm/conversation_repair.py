"""Repair of conversation structure as a lightest derivation.

A conversation is legal when the initials of its roles read ``(s?(ua)+)?``. A repair is a derivation: the item (i, q)
says that the first i rows are repaired and that the roles put out so far leave the recogniser in state q. An edit of
row i is the second antecedent that takes (i, q) to (i + 1, q'), an insertion one that takes it to (i, q'). The weight
of a deduction is (cost, audit): costs add, audits are joined. Both grow, so the function is superior, and Knuth's
agenda may finalise the least item it holds. Ties: two audits of one item and one cost are never prefixes of each
other (the longer one would have more insertions, which cost), so what follows cannot change their order.

A conversation of any length is cut into blocks of at most ``BLOCK`` rows by turn; the agenda of a block starts from
every state, and a second agenda joins the blocks, whose lightest derivations are its axioms. A hot conversation is
so dealt over many tasks. Only its audit, a letter for each edit, and its hash, which is sequential by nature, are
made in one task: the blocks stream through it, one in memory at a time.

Defined results: a null role or text is one space, a null id or turn stands as one space in the damage rule; rows
come by turn (null first), then role, then text; repeated rows are duplicates of the first; an id whose rows are all
gone keeps a row of zeros; a null ``conv_id`` is one conversation; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Hashable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelens.llm.common import per_worker
from scorelens.session import cut_lineage

#: Turns that share a block; a turn with more rows than this, or rows with more characters than that, is cut as well.
BLOCK, BLOCK_CHARS = 256, 4_000_000
#: White space: space and \t to \r.
BLANKS = " \t\n\x0b\x0c\r"
#: Costs of edits, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: (state, role initial) -> state. 0: nothing put out, 1: after s, 2: after u, 3: after a.
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
ACCEPT = (0, 3)
STATES = range(4)

ROWS = "conv_id long, slot long, turn long, role string, text string, repeated boolean"
ITEMS = "array<struct<source: int, target: int, cost: long, audit: string>>"
BLOCKS = (
    "conv_id long, slot long, part int, first_turn long, last_turn long, turns long, blank long, duplicate long, "
    f"truncated long, illegal long, first string, last string, items {ITEMS}, roles array<string>, texts array<string>"
)
RESULT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string"
)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that crc32 of ``conv_id:turn`` modulo 20 selects."""
    one_space = lambda c: F.coalesce(conversations[c].cast("string"), F.lit(" "))
    pick = F.crc32(F.concat(one_space("conv_id"), F.lit(":"), one_space("turn"))) % 20
    rows = conversations.select(
        conversations["conv_id"].cast("long").alias("conv_id"),
        conversations["turn"].cast("long").alias("turn"),
        one_space("role").alias("role"),
        one_space("text").alias("text"),
        pick.alias("pick"),
    ).filter("pick <> 0")
    text = F.when(F.col("pick") == 1, "").when(F.col("pick") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("pick") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.explode(F.when(F.col("pick") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _turn_order(turn: str) -> Column:
    return F.struct(F.col(turn).isNotNull().alias("known"), F.col(turn).alias("turn"))


def _with_repeats(rows: DataFrame) -> DataFrame:
    """Adds ``repeated``: the same role and text stand at an earlier turn of the conversation.

    Only texts that stand at several turns are joined, by their digest; a hot text collapses before the shuffle.
    """
    keyed = rows.withColumn("digest", F.unhex(F.md5("text")))
    order = _turn_order("turn")
    several = (
        keyed.groupBy("conv_id", "role", "digest")
        .agg(F.min(order).alias("first"), F.max(order).alias("latest"))
        .filter("first <> latest")
        .select(*(F.col(c).alias(f"{c}_r") for c in ("conv_id", "role", "digest")), "first")
    )
    same = (
        F.col("conv_id").eqNullSafe(F.col("conv_id_r"))
        & (F.col("role") == F.col("role_r"))
        & (F.col("digest") == F.col("digest_r"))
    )
    return keyed.join(several, same, "left").select(
        "conv_id",
        F.shiftright("turn", BLOCK.bit_length() - 1).alias("slot"),
        "turn",
        "role",
        "text",
        F.coalesce(_turn_order("turn") > F.col("first"), F.lit(False)).alias("repeated"),
    )


Weight = tuple[int, str]
Deduction = tuple[int, str, Hashable]


def agenda(
    start: Hashable, deductions: Callable[[Hashable], Iterable[Deduction]], goal: Hashable = None
) -> dict[Hashable, Weight]:
    """Lightest weight of each item that ``start`` derives, up to ``goal``.

    ``deductions(item)`` gives (cost, audit, head) for each rule in which the item and an axiom of weight (cost, audit)
    derive ``head``. The superior function adds the costs and joins the audits; the least item on the agenda is final.
    """
    final: dict[Hashable, Weight] = {}
    waiting = [(0, "", start)]
    while waiting:
        cost, audit, item = heapq.heappop(waiting)
        if item in final:
            continue
        final[item] = (cost, audit)
        if item == goal:
            break
        for more, edits, head in deductions(item):
            if head not in final:
                heapq.heappush(waiting, (cost + more, audit + edits, head))
    return final


def block_items(signs: tuple[str, ...]) -> list[dict]:
    """Lightest derivations over a block, for every pair of states that has one.

    ``signs`` has "x" for a row that must go, else the initial of the row's role, with "-" behind it if truncated.
    """
    n = len(signs)

    def deductions(item):
        i, q = item
        for initial in "ua":
            if (q, initial) in MOVES:
                yield INSERT, "I", (i, MOVES[q, initial])
        if i == n:
            return
        yield DELETE, "D", (i + 1, q)
        if signs[i] == "x":
            return
        extra = TRUNCATED if signs[i].endswith("-") else 0
        kept = MOVES.get((q, signs[i].rstrip("-")))
        if kept is not None:
            yield extra, "K", (i + 1, kept)
        for initial in "ua":
            if (q, initial) in MOVES:
                yield REROLE + extra, "R", (i + 1, MOVES[q, initial])

    out = []
    for source in STATES:
        final = agenda((0, source), deductions)
        for target in STATES:
            if (n, target) in final:
                cost, audit = final[n, target]
                out.append({"source": source, "target": target, "cost": cost, "audit": audit})
    return out


def _known_items(signs: tuple[str, ...]) -> list[dict]:
    """``block_items``, kept by worker for some thousands of short blocks, as most conversations look alike."""
    kept = per_worker("repairs", dict)
    if signs not in kept:
        if len(kept) >= 10_000:
            kept.clear()
        kept[signs] = block_items(signs)
    return kept[signs]


def _block(key: tuple, part: int, rows: list[tuple]) -> dict:
    """rows: (turn, role, text, must be a duplicate)."""
    signs, faults = [], {"blank": 0, "duplicate": 0, "truncated": 0}
    initials = [role[:1] for _, role, _, _ in rows]
    for (_, _, text, seen), initial in zip(rows, initials):
        trimmed = text.rstrip(BLANKS)
        fault = "blank" if not trimmed else "duplicate" if seen else "truncated" if trimmed[-1] not in ".!?" else None
        if fault:
            faults[fault] += 1
        # Roles outside the recogniser's alphabet are alike: they cannot be kept.
        sign = initial if initial and initial in "sua" else "o"
        signs.append("x" if fault in ("blank", "duplicate") else sign + "-" if fault else sign)
    turns = [t for t, *_ in rows if t is not None]
    return faults | {
        "conv_id": key[0],
        "slot": key[1],
        "part": part,
        "first_turn": turns[0] if turns else None,
        "last_turn": turns[-1] if turns else None,
        "turns": len(set(turns)),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "first": initials[0],
        "last": initials[-1],
        "items": _known_items(tuple(signs)),
        "roles": [r for _, r, _, _ in rows],
        "texts": [t for _, _, t, _ in rows],
    }


def _flush(out: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(out, schema=schema)


def _blocks(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (conv_id, slot, turn, role, text) into blocks; a block and some results are in memory."""
    key, part, rows, before, out, chars, held = None, 0, [], None, [], 0, 0
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(6)]
        for conv, slot, turn, role, text, repeated in zip(*columns):
            if (conv, slot) != key or len(rows) == BLOCK or chars > BLOCK_CHARS:
                if rows:
                    out.append(_block(key, part, rows))
                part = part + 1 if (conv, slot) == key else 0
                before, key = (before if (conv, slot) == key else None), (conv, slot)
                rows, chars, held = [], 0, held + chars
                if held > BLOCK_CHARS or len(out) == 256:
                    yield _flush(out, schema)
                    out, held = [], 0
            rows.append((turn, role, text, repeated or (turn, role, text) == before))
            before = (turn, role, text)
            chars += len(text)
    if rows:
        out.append(_block(key, part, rows))
    if out:
        yield _flush(out, schema)


def _runs(batches: Iterator[pa.RecordBatch], size: int = 256) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield from batch.slice(at, size).to_pylist()


def _joined(conv: int | None, blocks: list[dict]) -> Iterator[dict]:
    """The conversation's figures, then the audit of each block and the number of rows put out before it."""
    n = len(blocks)
    goal = (n + 1, 0)
    edges: dict[tuple, list[Deduction]] = {}
    for k, block in enumerate(blocks):
        for x in block["items"]:
            edges.setdefault((k, x["source"]), []).append((x["cost"], x["audit"], (k + 1, x["target"])))
    for state in ACCEPT:
        edges[n, state] = [(0, "", goal)]
    cost, audit = agenda((0, 0), lambda item: edges.get(item, ()), goal)[goal]
    figures = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    low = high = last = None
    turns = 0
    for block in blocks:
        for name in figures:
            figures[name] += block[name]
        if last is not None:
            figures["illegal"] += last + block["first"] not in ("su", "ua", "au")
        last = block["last"]
        if block["first_turn"] is not None:
            turns += block["turns"] - (high == block["first_turn"])
            low, high = (block["first_turn"] if low is None else low), block["last_turn"]
    yield figures | {
        "conv_id": conv,
        "kind": 0,
        "gaps": 0 if low is None else high - low + 1 - turns,
        "cost": cost,
        "audit": audit,
    }
    # Every block consumes its own number of rows; insertions between two blocks belong to the earlier one.
    at = put = 0
    odd = sum(letter != "D" for letter in audit) % 2
    for k, block in enumerate(blocks):
        left, begin = block["n_rows"], at
        while at < len(audit) and (left or audit[at] == "I" or k + 1 == n):
            left -= audit[at] != "I"
            at += 1
        piece = audit[begin:at]
        yield {"conv_id": conv, "kind": 1, "slot": block["slot"], "part": block["part"], "audit": piece, "put": put, "odd": odd}
        put += len(piece) - piece.count("D")


def _join_blocks(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Block summaries, sorted by (conv_id, slot, part), a row without a slot's items for each id, to figures and paths."""
    conv, blocks, began, out = None, [], False, []
    for row in _runs(batches):
        if began and row["conv_id"] != conv:
            out.extend(_joined(conv, blocks))
            blocks = []
            if len(out) >= 256:
                yield _flush(out, schema)
                out = []
        began, conv = True, row["conv_id"]
        if row["items"] is not None:
            blocks.append(row)
    if began:
        out.extend(_joined(conv, blocks))
    if out:
        yield _flush(out, schema)


def repaired(rows: Iterable[tuple[str, str]], audit: str, put: int, odd: int) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired rows. ``put`` rows stand before these; ``odd`` says that a system row leads."""
    rows = iter(rows)
    for letter in audit:
        role, text = next(rows) if letter != "I" else ("", "")
        if letter == "D":
            continue
        if letter != "K":
            role = ("user", "assistant")[(put - odd) % 2]
        yield role, text
        put += 1


def _hashes(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Figures, paths and blocks, sorted by (conv_id, slot, part, kind), to one result per conversation."""
    result, path, digest, empty, out = None, None, None, True, []

    def done() -> dict:
        return {name: result[name] for name in schema.names[:-1]} | {"repaired_sha256": digest.hexdigest()}

    for row in _runs(batches, 16):
        if row["kind"] == 0:
            if result is not None:
                out.append(done())
            result, digest, empty = row, hashlib.sha256(), True
            if len(out) >= 256:
                yield _flush(out, schema)
                out = []
        elif row["kind"] == 1:
            path = row
        else:
            for role, text in repaired(zip(row["roles"], row["texts"]), path["audit"], path["put"], path["odd"]):
                digest.update(("" if empty else "\n").encode() + f"{role}:{text}".encode())
                empty = False
    if result is not None:
        out.append(done())
    if out:
        yield _flush(out, schema)


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def _mapped(df: DataFrame, fn: Callable, ddl: str) -> DataFrame:
    schema = _arrow(df.sparkSession, ddl)
    return df.mapInArrow(lambda batches: fn(batches, schema), ddl)


def repair(conversations: DataFrame) -> DataFrame:
    """Figures, cheapest edits and hash of each repaired conversation, after the damage of ``damaged``."""
    return repair_rows(damaged(conversations), conversations.select(F.col("conv_id").cast("long").alias("conv_id")))


def repair_rows(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """As ``repair``, for rows (conv_id, turn, role, text) taken as they are; one result for each id of ``ids``."""
    blocks = cut_lineage(
        _mapped(
            _with_repeats(rows)
            .repartition("conv_id", "slot")
            .sortWithinPartitions("conv_id", "slot", F.asc_nulls_first("turn"), "role", "text"),
            _blocks,
            BLOCKS,
        )
    )
    summary = blocks.withColumn("n_rows", F.size("roles")).drop("roles", "texts")
    marks = ids.distinct()
    paths_ddl = RESULT.rsplit(",", 1)[0] + ", kind int, slot long, part int, put long, odd int"
    paths = cut_lineage(
        _mapped(
            summary.unionByName(marks, allowMissingColumns=True)
            .repartition("conv_id")
            .sortWithinPartitions("conv_id", F.asc_nulls_first("slot"), "part"),
            _join_blocks,
            paths_ddl,
        )
    )
    texts = blocks.select("conv_id", "slot", "part", "roles", "texts", F.lit(2).alias("kind"))
    return _mapped(
        paths.unionByName(texts, allowMissingColumns=True)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", F.expr("kind > 0"), F.asc_nulls_first("slot"), "part", "kind"),
        _hashes,
        RESULT,
    )
