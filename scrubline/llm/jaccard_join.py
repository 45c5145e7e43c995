"""Exact similarity join of documents by the Jaccard overlap of their word shingles.

Documents of equal shingle sets are one class. A set can only be similar to one that it shares a
shingle with among its rarest ``n - T + 1`` (T is the least overlap): those are the short lists of
the T-occurrence problem. Shingles that only one class has there are dropped, and with them all
classes that can have no partner. The rest meet in groups: all classes that share a short list
belong to the group of the list's first class, so every similar pair meets in one. Inside a group
the search runs on inverted lists: short ones merged, long ones probed (DivideSkip).

Before whole sets travel to a group, its members meet by bitmaps of about a bit for every two shingles.
A bit holds the parity of the shingles that fall on it, so two bitmaps differ in no more bits than the
sets in shingles, and a member whose bitmap is too far from all others of the group stays away from it.

Rarity comes from a fixed-size table of counters, summed over all documents; it decides only which
lists count as short, so its size affects speed and never the result.

A group of more than ``BLOCK_SHINGLES`` is divided. Each block links its members (near copies all to one
another's leader). Then a few heads, the most linked member of some blocks, visit all blocks, so that a
family that was dealt over the blocks joins. Only members still outside the group's main component
visit the other blocks after that. They are dealt in parts of the size of a block, and a task has one
part and one block at a time. Pairs inside a component are never listed; what is shuffled grows with
the square of a group only as far as its members are similar to nothing in the main component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.llm.components import connected
from scrubline.llm.shared import held, map_batches, partitions, portions, text_bytes, texts_of
from scrubline.llm.shingles import fingerprint, shingle_sets
from scrubline.llm.t_occurrence import group_links, required

COUNTERS = 1 << 20
SLICES = 16
BLOCK_SHINGLES = 1 << 20
HEADS = 16
LEAST_BITS = 64
MOST_COMPARED = 512
HOT_LIST = 20_000
SALTS = 32
BROADCAST_ROWS = 1_000_000


def linked_components(
    docs: DataFrame,
    width: int = 4,
    percent: int = 85,
    key: str = "doc_id",
    text: str = "text",
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id``.

    Two documents link if ``100 * intersection >= percent * union`` of their distinct shingles of
    ``width`` words. ``component_id`` is the smallest doc_id reachable by links. Null texts and
    texts without words have no shingles and link with nothing, their component is their own id.
    Texts of fewer words have one shingle. Repeated rows are one class; an empty table gives an
    empty result. Sets are told apart by 64-bit fingerprints.
    """
    body = text_bytes(F.col("text"))
    narrow = texts_of(docs, key, text).select(
        "doc_id", F.xxhash64(body).alias("hash"), body.alias("body")
    )
    scanned = held(_scan(narrow, width), "shingled")
    sized = scanned.where("counters is null").select("doc_id", "n_shingles", "class")
    # the text that a class is read from: null ids and repeated ids are told apart by its hash
    reader = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "hash"))
    classes = held(
        scanned.where("n_shingles > 0").groupBy("class").agg(
            reader.alias("reader"), F.max("n_shingles").alias("n_shingles"), F.any_value("bitmap").alias("bitmap")
        ).select("class", "n_shingles", "bitmap", F.col("reader.doc_id").alias("first_id"), F.col("reader.hash").alias("first_hash")),
        "classes",
    )
    members = _members(_short_lists(narrow, _counters(scanned), width, percent))
    links = _links(members.join(classes, "class"), narrow, width, percent, block_shingles)
    roots = connected(links)
    labelled = classes.join(roots, classes["class"] == roots["node"], "left").select(
        "class", "first_id", F.coalesce("root", "class").alias("root")
    )
    smallest = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = held(
        labelled.join(smallest, "root").select(F.col("class").alias("named"), "component_id"), "named"
    )
    joined = sized.join(named, sized["class"] == named["named"], "left")
    whole = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", whole.alias("component_id"))


def parity_bitmap(shingles: np.ndarray) -> bytes:
    """The parity of the shingles that fall on each bit; bits are a power of two, at least half the shingles."""
    bits = max(LEAST_BITS, 1 << max(0, (len(shingles) + 1) // 2 - 1).bit_length())
    counts = np.bincount((shingles % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits(counts & 1, bitorder="little").tobytes()


def may_link(sizes: np.ndarray, bitmaps: list[bytes], percent: int) -> np.ndarray:
    """Which sets of a group can be similar to another of it, as far as sizes and bitmaps tell.

    Longer bitmaps are folded to the shortest: a bit of the fold is the parity of the bits it stands for.
    """
    width = min(map(len, bitmaps))
    folded = [np.frombuffer(b, dtype=np.uint64).reshape(-1, width // 8) for b in bitmaps]
    rows = np.array([np.bitwise_xor.reduce(f, axis=0) for f in folded])
    possible = np.zeros(len(rows), dtype=bool)
    for k in range(len(rows) - 1):
        apart = np.bitwise_count(rows[k + 1 :] ^ rows[k]).sum(axis=1, dtype=np.int64)
        other = sizes[k + 1 :]
        near = (100 + percent) * apart <= (100 - percent) * (other + sizes[k])
        near &= 100 * np.minimum(other, sizes[k]) >= percent * np.maximum(other, sizes[k])
        possible[k] |= near.any()
        possible[k + 1 :] |= near
    return possible


def _scan(narrow: DataFrame, width: int) -> DataFrame:
    """Set size and class of each document; each task adds its counters, in slices."""
    kind = narrow.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, hash bigint, n_shingles bigint, class bigint, bitmap binary, slice int, counters binary"
    id_type = None

    def scan(batches):
        nonlocal id_type
        table = np.zeros(COUNTERS, dtype=np.uint32)
        names = ["doc_id", "hash", "n_shingles", "class", "bitmap", "slice", "counters"]
        for batch in portions(batches, "body"):
            id_type = batch.column("doc_id").type
            sets = shingle_sets(batch.column("body").to_pylist(), width)
            if sets:
                every = np.concatenate(sets)
                table += np.bincount(
                    (every % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS
                ).astype(np.uint32)
            nulls = pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("hash"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([fingerprint(s) for s in sets], pa.int64()),
                    pa.array([parity_bitmap(s) for s in sets], pa.binary()),
                    *nulls,
                ],
                names,
            )
        if id_type is not None:
            parts = [part.tobytes() for part in np.split(table, SLICES)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(SLICES, id_type),
                    pa.nulls(SLICES, pa.int64()),
                    pa.nulls(SLICES, pa.int64()),
                    pa.nulls(SLICES, pa.int64()),
                    pa.nulls(SLICES, pa.binary()),
                    pa.array(range(SLICES), pa.int32()),
                    pa.array(parts, pa.binary()),
                ],
                names,
            )

    return map_batches(narrow, scan, schema)


def _counters(scanned: DataFrame) -> np.ndarray:
    """The counters of all tasks, summed: 4 MB, whatever the number of documents."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column("slice").to_pylist(), batch.column("counters").to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(part, dtype=np.uint32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(total), pa.int32()),
                pa.array([v.astype(np.uint32).tobytes() for v in total.values()], pa.binary()),
            ],
            ["slice", "counters"],
        )

    tables = scanned.where("counters is not null").select("slice", "counters")
    schema = "slice int, counters binary"
    merged = map_batches(
        map_batches(tables, add, schema).repartition(SLICES, "slice"), add, schema
    )
    found = {r["slice"]: np.frombuffer(bytes(r["counters"]), dtype=np.uint32) for r in merged.collect()}
    empty = np.zeros(COUNTERS // SLICES, dtype=np.uint32)
    return np.concatenate([found.get(k, empty) for k in range(SLICES)])


def _short_lists(narrow: DataFrame, counters: np.ndarray, width: int, percent: int) -> DataFrame:
    """Short lists: ``(class, leader)`` for the rarest shingles that several classes have.

    Lists that the counters show to be long are dealt out in ``SALTS`` parts; ``hot`` names them.
    """
    hot = max(HOT_LIST, 4 * float(counters.mean()))
    shipped = narrow.sparkSession.sparkContext.broadcast(counters)

    def rarest(batches):
        table = shipped.value
        for batch in portions(batches, "body"):
            tokens, owners, salts, sizes, seen = [], [], [], [], set()
            for shingles in shingle_sets(batch.column("body").to_pylist(), width):
                if not len(shingles) or (name := fingerprint(shingles)) in seen:
                    continue
                seen.add(name)
                take = len(shingles) - required(len(shingles), percent) + 1
                rarity = table[(shingles % np.uint64(COUNTERS)).astype(np.int64)]
                order = np.argsort(rarity, kind="stable")[:take]  # ties by the shingle itself
                tokens.append(shingles[order])
                owners.append(np.full(take, name, dtype=np.int64))
                sizes.append(np.full(take, len(shingles), dtype=np.int32))
                salts.append(np.where(rarity[order] < hot, -1, name % SALTS).astype(np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(tokens).view(np.int64)),
                        pa.array(np.concatenate(salts)),
                        pa.array(np.concatenate(sizes)),
                        pa.array(np.concatenate(owners)),
                    ],
                    ["token", "salt", "n", "class"],
                )

    schema = "token bigint, salt int, n int, class bigint"
    rows = map_batches(narrow.select("body"), rarest, schema)
    parts = partitions(narrow.sparkSession)
    ordered = rows.repartition(parts, "token", "salt").sortWithinPartitions(
        "token", "salt", "n", "class"
    )

    def led(batches):
        return _led(batches, percent)

    return map_batches(ordered, led, "class bigint, leader bigint, hot bigint")


def _led(batches, percent: int):
    """Rows sorted by list and set size: each class with the first class of its run.

    A list is cut where the next set is too large to be similar to the one before it, and so to all
    before. Runs of one class go. A run may go over several batches. Its first row is the leader, so
    nothing is gathered; a first row waits until a second class of the run shows.
    """
    current = leader = None
    size = 0
    waiting = False
    for batch in batches:
        token, salt, n, name = (
            batch.column(c).to_numpy().astype(np.int64) for c in ("token", "salt", "n", "class")
        )
        if not len(token):
            continue
        new = np.ones(len(token), dtype=bool)
        gap = 100 * np.append(size, n[:-1]) < percent * n
        gap &= salt < 0  # the parts of a long list stay whole, so that they can be joined
        new[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
        new[0] = (int(token[0]), int(salt[0])) != current
        new |= gap
        size = int(n[-1])
        starts = np.flatnonzero(new)
        heads = np.full(len(token), leader if leader is not None else 0, dtype=np.int64)
        if len(starts):
            sizes = np.diff(np.append(starts, len(token)))
            heads[starts[0] :] = np.repeat(name[starts], sizes)
        follows = name != heads
        salted = salt >= 0  # the leader of a salted list has yet to meet those of its other parts
        keep = follows | salted
        # leaders of lists that have a second class in this batch
        led = np.unique(heads[follows & (np.cumsum(new) > 0)])
        keep |= new & np.isin(name, led)
        extra = []
        first_stop = int(starts[0]) if len(starts) else len(token)
        if waiting and follows[:first_stop].any():
            extra, waiting = [leader], False
        if len(starts):
            last = int(starts[-1])
            leader, current = int(name[last]), (int(token[-1]), int(salt[-1]))
            waiting = not follows[last:].any() and salt[-1] < 0
        hot = np.where(salted, token, 0)[keep]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([name[keep], np.array(extra, dtype=np.int64)])),
                pa.array(np.concatenate([heads[keep], np.array(extra, dtype=np.int64)])),
                pa.array(
                    np.concatenate([hot, np.zeros(len(extra), dtype=np.int64)]),
                    mask=np.concatenate([~salted[keep], np.ones(len(extra), dtype=bool)]),
                ),
            ],
            ["class", "leader", "hot"],
        )


def _members(led: DataFrame) -> DataFrame:
    """Each class with the groups it belongs to; the parts of a salted list share its least leader."""
    rows = held(led.distinct(), "members")
    tops = rows.where("hot is not null").groupBy("hot").agg(
        F.min("leader").alias("top"), F.max("class").alias("last")
    )
    tops = tops.where("top < last").withColumnRenamed("hot", "list")
    salted = rows.where("hot is not null")
    salted = salted.join(tops, salted["hot"] == tops["list"]).select("class", F.col("top").alias("leader"))
    return rows.where("hot is null").select("class", "leader").union(salted).distinct()


def _links(
    members: DataFrame, narrow: DataFrame, width: int, percent: int, block_shingles: int
) -> DataFrame:
    sizes = members.groupBy("leader").agg(F.sum("n_shingles").alias("n"))
    blocks = F.ceil(F.col("n") / block_shingles).cast("int")
    bitmap = F.when(F.col("blocks") == 1, F.col("bitmap")).alias("bitmap")
    # dealt by the leader too: groups that share members divide them differently
    dealt = members.join(sizes.select("leader", blocks.alias("blocks")), "leader").select(
        "class", "leader", "blocks", "first_id", "first_hash", "n_shingles", bitmap,
        F.pmod(F.xxhash64("class", "leader"), F.col("blocks")).cast("int").alias("block"),
    )
    dealt = held(dealt, "dealt")
    alone = _hopeful(dealt, percent).select("class", "leader", "first_id", "first_hash", *_jobs(F.array("block")), F.lit(False).alias("asks"))
    found = held(_search(_with_sets(alone, narrow, width), percent, False), "links")
    divided = dealt.where("blocks > 1")
    if divided.isEmpty():
        return found
    outside = _outside(divided, found)
    if outside.isEmpty():
        return found
    open_groups = divided.join(outside.select("leader").distinct(), "leader", "left_semi")
    visits = _visits(_heads(open_groups, found), open_groups, 1 << 62)
    found = found.unionByName(held(_search(_with_sets(visits, narrow, width), percent, True), "links"))
    outside = _outside(divided, found)
    if outside.isEmpty():
        return found
    visits = _visits(outside, divided, block_shingles)
    return found.unionByName(held(_search(_with_sets(visits, narrow, width), percent, True), "links"))


def _hopeful(dealt: DataFrame, percent: int) -> DataFrame:
    """The dealt members less those of undivided groups that can be similar to no other of the group.

    A group of more than ``MOST_COMPARED`` members is not compared and stays whole.
    """
    carried = ["class", "leader", "first_id", "first_hash", "block"]
    once = dealt.where("blocks = 1").select(*carried, "n_shingles", "bitmap")

    def compare(batches):
        pending: list[pa.RecordBatch] = []  # slices of the current group
        current, waiting = None, 0

        def settle():
            if waiting > MOST_COMPARED:  # gone on already
                return []
            table = pa.Table.from_batches(pending)
            sizes = table.column("n_shingles").to_numpy()
            near = may_link(sizes, table.column("bitmap").to_pylist(), percent)
            return table.filter(pa.array(near)).select(carried).to_batches()

        for batch in batches:
            leaders = batch.column("leader").to_numpy()
            cuts = [0, *(np.flatnonzero(leaders[1:] != leaders[:-1]) + 1).tolist(), len(leaders)]
            for begin, end in zip(cuts, cuts[1:]):
                if begin == end:
                    continue
                if current != int(leaders[begin]):
                    if pending:
                        yield from settle()
                    pending, current, waiting = [], int(leaders[begin]), 0
                pending.append(batch.slice(begin, end - begin))
                waiting += end - begin
                if waiting > MOST_COMPARED:
                    for part in pending:
                        yield part.select(carried)
                    pending = [pending[-1].slice(0, 0)]
        if pending:
            yield from settle()

    parts = partitions(dealt.sparkSession)
    ordered = once.repartition(parts, "leader").sortWithinPartitions("leader")
    kept = map_batches(ordered, compare, once.select(*carried).schema)
    return kept.unionByName(dealt.where("blocks > 1").select(*carried))


def _outside(divided: DataFrame, found: DataFrame) -> DataFrame:
    """The members of divided groups that the links found leave outside the group's main component."""
    roots = connected(found)
    rooted = divided.join(roots, divided["class"] == roots["node"], "left").select(
        *divided.columns, F.coalesce("root", "class").alias("root")
    )
    tallied = rooted.groupBy("leader", "root").agg(F.count(F.lit(1)).alias("n"))
    main = tallied.groupBy("leader").agg(F.max(F.struct("n", "root"))["root"].alias("main"))
    return held(rooted.join(main, "leader").where("root <> main").select(*divided.columns), "outside")


def _heads(divided: DataFrame, found: DataFrame) -> DataFrame:
    """The most linked member of a block, for ``HEADS`` blocks of each group."""
    ends = found.select(F.explode(F.array("a", "b")).alias("end"))
    degrees = ends.groupBy("end").agg(F.count(F.lit(1)).alias("degree"))
    linked = divided.join(degrees, divided["class"] == degrees["end"])
    first = F.max(F.struct("degree", "class", "first_id", "first_hash", "n_shingles", "blocks")).alias("head")
    spread = linked.where(F.col("block") < HEADS).groupBy("leader", "block").agg(first)
    return held(
        spread.select(
            "head.class", "leader", "head.blocks", "head.first_id", "head.first_hash", "head.n_shingles", "block"
        ),
        "heads",
    )


def _jobs(blocks, parts=None) -> list:
    """The columns ``to_blocks`` and ``to_parts``: a row goes to every pair of the two."""
    return [
        blocks.cast("array<int>").alias("to_blocks"),
        (F.array(F.lit(0)) if parts is None else parts).cast("array<int>").alias("to_parts"),
    ]


def _visits(asking: DataFrame, divided: DataFrame, part_shingles: int) -> DataFrame:
    """The asking members, dealt in parts, to all blocks but their own, whose members they have met.

    Every block meets every part, so each asking member meets each member of its group, and no task
    has more at once than a block and a part.
    """
    counted = asking.groupBy("leader").agg(
        F.ceil(F.sum("n_shingles") / part_shingles).cast("int").alias("parts")
    )
    part = F.pmod(F.xxhash64("leader", "class"), F.col("parts"))
    every = F.expr("sequence(0, blocks - 1)")
    going = asking.join(counted, "leader").select(
        "class", "leader", "first_id", "first_hash", *_jobs(F.array_remove(every, F.col("block")), F.array(part)),
        F.lit(True).alias("asks"),
    )
    at_home = divided.join(counted, "leader").select(
        "class", "leader", "first_id", "first_hash",
        *_jobs(F.array("block"), F.expr("sequence(0, parts - 1)")), F.lit(False).alias("asks"),
    )
    return held(going.unionByName(at_home), "visits")


def _with_sets(dealt: DataFrame, narrow: DataFrame, width: int) -> DataFrame:
    """The dealt classes with their shingles, read from the text of each class's first document."""
    rows = dealt.select(
        "class", "leader", "to_blocks", "to_parts", "asks",
        F.col("first_id").alias("reader"), F.col("first_hash").alias("reader_hash"),
    )
    jobs = rows.agg(F.sum(F.size("to_blocks") + F.size("to_parts") - 1)).first()[0] or 0
    if jobs <= BROADCAST_ROWS:
        rows = F.broadcast(rows)
    own = narrow["doc_id"].eqNullSafe(rows["reader"]) & (narrow["hash"] == rows["reader_hash"])
    texts = narrow.join(rows, own)
    carried = ["leader", "to_blocks", "to_parts", "class", "asks"]

    def read(batches):
        done = set()  # rows that repeat an id and its text go on once from each task
        for batch in portions(batches, "body"):
            jobs = zip(*(batch.column(c).to_pylist() for c in ("class", "leader", "to_blocks", "to_parts")))
            fresh = []
            for name, leader, *at in jobs:
                job = hash((name, leader, *map(tuple, at)))
                fresh.append(job not in done)
                done.add(job)
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            sets = shingle_sets(batch.column("body").to_pylist(), width)
            # texts whose hashes collide are told apart by the class
            right = pa.array(
                [fingerprint(s) == c for s, c in zip(sets, batch.column("class").to_pylist())],
                pa.bool_(),
            )
            blobs = pa.array([s.tobytes() for s in sets], pa.binary())
            columns = [batch.column(c) for c in carried]
            yield pa.RecordBatch.from_arrays([*columns, blobs], [*carried, "shingles"]).filter(right)

    schema = (
        "leader bigint, to_blocks array<int>, to_parts array<int>, class bigint, asks boolean, "
        "shingles binary"
    )
    filled = map_batches(texts.select("body", *carried), read, schema)
    return filled.withColumn("block", F.explode("to_blocks")).select(
        "leader", "block", F.explode("to_parts").alias("part"), "class", "asks", "shingles"
    )


def _search(filled: DataFrame, percent: int, asked: bool) -> DataFrame:
    """Links inside each job of each group (a block and a part of those that ask).

    With ``asked`` only the links of the asking members.
    """

    def links(batches):
        pending: dict[int, tuple] = {}  # a class that comes again takes no more room
        current = None

        def solve():
            names = sorted(pending)
            sets = [np.frombuffer(pending[c][1], dtype=np.uint64) for c in names]
            queries = np.array([i for i, c in enumerate(names) if pending[c][0]]) if asked else None
            return [(names[a], names[b]) for a, b in group_links(sets, percent, queries)]

        for batch in portions(batches, "shingles"):
            columns = (batch.column(c).to_pylist() for c in ("leader", "block", "part", "class", "asks", "shingles"))
            out = []
            for *job, name, asks, blob in zip(*columns):
                if job != current:
                    if len(pending) > 1:
                        out += solve()
                    pending, current = {}, job
                pending[name] = (asks or pending.get(name, (False,))[0], blob)
            yield _pairs(out)
        if len(pending) > 1:
            yield _pairs(solve())

    parts = partitions(filled.sparkSession)
    ordered = filled.select("leader", "block", "part", "class", "asks", "shingles").repartition(
        parts, "leader", "block", "part"
    ).sortWithinPartitions("leader", "block", "part")
    return map_batches(ordered, links, "a bigint, b bigint")


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())],
        ["a", "b"],
    )


def keep_one_per_component(
    docs: DataFrame, width: int = 4, percent: int = 85, key: str = "doc_id"
) -> DataFrame:
    """``docs`` with the smallest id of each component alone, one row of it; all columns kept.

    Rows are told apart by id and text (64 bits of hash), so ids may be null, which come last, or
    stand for several texts. Rows without words are in no component and all stay. Other columns may
    have any names; an empty table stays empty.
    """
    named = F.struct(
        F.col(key).isNull().alias("missing"), F.col(key).alias("id"),
        F.xxhash64(F.col("text").cast("string")).alias("hash"),
    )
    # the row travels whole, so that no name of its own can clash
    tagged = docs.select(named.alias("row"), F.struct("*").alias("whole"))
    found = held(linked_components(tagged, width, percent, "row", "whole.text"), "components")
    stay = found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("stays")).agg(
        F.sum(F.when(F.col("n_shingles") > 0, 1).otherwise(0)).alias("repeats")
    )
    once = stay.where("repeats < 2").select("stays")
    kept = tagged.join(once, tagged["row"] == once["stays"], "left_semi")
    repeated = held(stay.where("repeats > 1").select("stays"), "repeated")
    if not repeated.isEmpty():  # rows of one id and text
        copies = tagged.join(repeated, tagged["row"] == repeated["stays"], "left_semi")
        kept = kept.unionByName(copies.dropDuplicates(["row"]))
    return kept.select("whole.*")
