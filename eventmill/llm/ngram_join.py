"""Exact Jaccard join of shingle sets, down to the components of its links, with set relations that skip work."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventmill.llm.common import saved
from eventmill.llm.components import connected_components
from eventmill.llm.shingles import fingerprint, shingle_sets
from eventmill.session import bound_batches

#: Shingles that at least this many sets have near their front come last in every set's order. Only the order depends on
#: them, never the result, so the list of them may be cut: to the most frequent, 8 MB at this size.
FREQUENT, LEAST_SEEN = 2**20, 8
#: Shingles counted at a time in a task before they are shuffled.
COUNTED = 250_000
#: Index entries in a batch, about.
ENTRIES = 100_000
#: Rounds with one hub per index list at most, before what is left is compared by blocks. A further round shuffles the lists
#: again, so there is one only while more than `OPEN` pairs per entry of the index are left to compare.
HUB_ROUNDS, OPEN = 3, 4
#: Sets in a block of an index list.
BLOCK = 256
#: So many blocks of a list are made in one place; those of a longer list in several, so that a join can be split there.
LANES = 16
#: Bits of a set's sketch, see `_sketches`.
SKETCH_BITS = 1024
#: Earlier tokens of its set that an entry carries, so that most pairs come up once and not in each list they share.
RECENT = 4
#: Ids sent to all tasks, 16 bytes each; more are joined by a shuffle.
SENT_IDS = 2_000_000

#: Bits of a set's fingerprint in its number; sets that meet there get others, see `_numbered`.
ID_BITS = 56
_LOW = (1 << 56) - 1


def _first_places(n: int, percent: int) -> int:
    """So many tokens at the front of a set of n hold one of any set that links with it."""
    return n - (percent * n + 99) // 100 + 1


def _set_number(print_: bytes, again: bool, bits: int) -> int:
    """The first bits of a fingerprint, or those that follow them."""
    return int.from_bytes(print_, "big") >> (128 - bits * (1 + again)) & ((1 << bits) - 1)


def _own_sets(docs: DataFrame, width: int) -> DataFrame:
    """A row `doc_id, n, print, low, low2` per document: size, fingerprint and two numbers of its set."""
    bits = ID_BITS

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(len(s), fingerprint(s)) for s in shingle_sets(batch.column("text"), width)]
            numbers = [pa.array([_set_number(p, again, bits) for _, p in sets], pa.int64()) for again in (False, True)]
            own = [pa.array([n for n, _ in sets], pa.int32()), pa.array([p for _, p in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *own, *numbers], names=["doc_id", "n", "print", "low", "low2"]
            )

    return docs.select("doc_id", "text").mapInArrow(survey, "doc_id bigint, n int, print binary, low bigint, low2 bigint")


def _numbered(sets: DataFrame) -> tuple[DataFrame, frozenset[bytes]]:
    """`sets` whose `low` tells them apart, and the fingerprints of those that have it from their second number.

    Different sets with one number are rare: about one of 10**7 among 10**10 sets. All of them move.
    """
    met = sets.groupBy("low").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1").select("low")
    moved = frozenset(bytes(r["print"]) for r in sets.join(met, "low", "left_semi").select("print").collect())
    if not moved:
        return sets.drop("low2"), moved
    again = F.col("print").isin([bytearray(p) for p in moved])
    return sets.withColumn("low", F.when(again, F.col("low2")).otherwise(F.col("low"))).drop("low2"), moved


def _counted(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """`token, seen`: in how many texts a token is near the front, for all tokens.

    Counted are twice the first places, in the order that knows no frequent tokens: where the frequent ones of a text are
    moved behind, the next ones move up.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def together() -> pa.RecordBatch:
            tokens, seen = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(seen.astype(np.int64))], names=["token", "seen"])

        for batch in batches:
            for s in shingle_sets(batch.column("text"), width):
                if len(s):
                    held.append(s[: 2 * _first_places(len(s), percent)].copy())
                    size += len(held[-1])
                if size >= COUNTED:
                    yield together()
                    held, size = [], 0
        if held:
            yield together()

    return docs.select("text").mapInArrow(count, "token bigint, seen bigint").groupBy("token").agg(F.sum("seen").alias("seen"))


def _frequent(counts: DataFrame) -> np.ndarray:
    """The tokens seen often, sorted; of more than `FREQUENT`, those above a step of the counts that leaves so many at most."""
    step = F.floor(F.log2("seen") * 8)
    often = saved(counts.where(F.col("seen") >= LEAST_SEEN).select("token", step.alias("step")), "frequent")
    least, total = None, 0
    for row in sorted(often.groupBy("step").count().collect(), reverse=True):  # 8 * 63 rows at most
        total += row["count"]
        if total > FREQUENT:
            break
        least = row["step"]
    if least is None:
        return np.zeros(0, np.uint64)
    listed = often.where(F.col("step") >= least).select("token").toPandas()["token"].to_numpy(np.int64)
    return np.sort(listed.view(np.uint64))


def _index(docs: DataFrame, width: int, percent: int, frequent: np.ndarray, moved: frozenset[bytes]) -> DataFrame:
    """Index entries `token, sid, n, pos, rep`: the first places of every set in the common order, `rep` being its document.

    Two sets that link share a token among these. `sid` is the share of frequent tokens, then the number of
    the set: of a group of near copies, the one with the fewest changes has the greatest.
    """
    sent, bits = docs.sparkSession.sparkContext.broadcast((frequent, moved)), ID_BITS

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, again = sent.value
        for batch in batches:
            out, size = [], 0
            for doc_id, s in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text"), width), strict=True):
                n = len(s)
                if not n:
                    continue
                place = np.minimum(np.searchsorted(known, s), max(0, len(known) - 1))
                often = known[place] == s if len(known) else np.zeros(n, bool)
                order = np.concatenate([s[~often], s[often]])[: _first_places(n, percent)]
                print_ = fingerprint(s)
                sid = int(127 * often.mean()) << 56 | _set_number(print_, print_ in again, bits)
                out.append((order, sid, n, doc_id))
                size += len(order)
                if size > ENTRIES:
                    yield _entry_batch(out)
                    out, size = [], 0
            if out:
                yield _entry_batch(out)

    return docs.select("doc_id", "text").mapInArrow(entries, "token bigint, sid bigint, n int, pos int, rep bigint")


def _entry_batch(rows: list[tuple[np.ndarray, int, int, int]]) -> pa.RecordBatch:
    lengths = np.array([len(o) for o, _, _, _ in rows])
    tokens = np.concatenate([o for o, _, _, _ in rows]).view(np.int64)
    sids, sizes, reps = (np.repeat(np.array([r[k] for r in rows], kind), lengths) for k, kind in ((1, np.int64), (2, np.int32), (3, np.int64)))
    places = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return pa.RecordBatch.from_arrays(
        [pa.array(tokens), pa.array(sids), pa.array(sizes), pa.array(places.astype(np.int32)), pa.array(reps)],
        names=["token", "sid", "n", "pos", "rep"],
    )


def _needed(a: Column, b: Column, percent: int) -> Column:
    """The least overlap of linked sets of these sizes."""
    return F.ceil(F.lit(percent) * (a + b) / F.lit(100.0 + percent) - F.lit(1e-9)).cast("int")


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent)


def _few(rows: DataFrame) -> bool:
    """Whether a saved table is small enough to be sent to all tasks."""
    return rows.count() <= SENT_IDS


def _overlaps(docs: DataFrame, placed: DataFrame, width: int, label: str) -> DataFrame:
    """`a, b, a_rep, b_rep, a_n, b_n, overlap` of pairs, a saved table without `overlap`, from whole texts."""
    ids = placed.select(F.explode(F.array("a_rep", "b_rep")).alias("doc_id"))
    ids = F.broadcast(ids) if 2 * placed.count() <= SENT_IDS else ids.distinct()
    texts = saved(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi"), f"{label}-texts")
    joined = placed.join(texts.select(F.col("doc_id").alias("a_rep"), F.col("text").alias("a_text")), "a_rep").join(
        texts.select(F.col("doc_id").alias("b_rep"), F.col("text").alias("b_text")), "b_rep"
    )
    kept = ["a", "b", "a_rep", "b_rep", "a_n", "b_n"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                pairs_ = zip(shingle_sets(batch.column("a_text"), width), shingle_sets(batch.column("b_text"), width), strict=True)
                found = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in pairs_]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(found, pa.int32())], names=[*kept, "overlap"])

    schema = "a bigint, b bigint, a_rep bigint, b_rep bigint, a_n int, b_n int, overlap int"
    return saved(joined.select(*kept, "a_text", "b_text").mapInArrow(compare, schema), f"{label}-overlaps")


def _links(overlaps: DataFrame, percent: int) -> DataFrame:
    linked = F.col("overlap") * (100 + percent) >= percent * (F.col("a_n") + F.col("b_n"))
    return overlaps.where(linked).select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"))


def _prefixes(index: DataFrame) -> DataFrame:
    """`sid, n, rep, tokens`: the shared tokens among the first places of every set."""
    return index.groupBy("sid").agg(F.min("n").alias("n"), F.min("rep").alias("rep"), F.collect_list("token").alias("tokens"))


def _promising(pairs: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """`a, b, a_rep, b_rep, a_n, b_n` of the pairs `a, b` of sids that the tokens common to their first places leave a chance to link.

    A common token that is not among the first places of both comes after the last of them in one of the two sets, so
    at most as many as that set has places left are still to come.
    """
    a, b = (prefixes.select(F.col("sid").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("n", "rep", "tokens")]) for x in "ab")
    common = F.size(F.array_intersect("a_tokens", "b_tokens"))
    to_come = F.floor((F.greatest("a_n", "b_n") * percent + 99) / 100) - 1
    hopeful = common + to_come >= _needed(F.col("a_n"), F.col("b_n"), percent)
    return pairs.join(b, "b").join(a, "a").where(hopeful).select("a", "b", "a_rep", "b_rep", "a_n", "b_n")


def _hub_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs `a, b` of the hubs and the other sets of their lists whose sizes fit and that are not in one component yet."""
    fit = _sizes_fit(F.col("n"), F.col("hub.n"), percent) & (F.col("part") != F.col("hub.part")) & (F.col("sid") != F.col("hub.sid"))
    # dealt by the set that is not the hub, as the next join wants it: no set has more pairs than first places
    return entries.where(fit).select(F.col("hub.sid").alias("a"), F.col("sid").alias("b")).repartition("b").distinct()


def _open_pairs(entries: DataFrame) -> int:
    """About how many pairs the lists hold whose sets are in different components: those with a set outside the largest."""
    return int(entries.agg(F.sum(F.col("sets").cast("double") - F.col("most"))).first()[0] or 0)


def _step(n: Column, percent: int) -> Column:
    """Sets that link are in one step of size or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / F.lit(1.001 * float(np.log(100 / percent)))).cast("int")


def _late(percent: int) -> Column:
    """An entry too far back to be that of the smaller set in a pair that links."""
    return F.col("n") - F.col("pos") < _needed(F.col("n"), F.col("n"), percent)


def _left(entries: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """What is open after a round: entries, except those of hubs, that may meet a set of another component in their list.

    `part` is the component of the set so far, by its own document where it has no link; `crowd` counts the list's sets in it,
    `most` the largest crowd, `others` the sets in crowds of less than a block. `hub` is a set of the largest crowd. All of
    that is found where the list's entries are: they are dealt once, by token.
    """
    rest = entries.where("sid <> hub.sid AND sets > 2").select("token", "sid", "n", "pos", "rep")
    known = parts.select(F.col("id").alias("rep"), "component")
    labelled = rest.join(F.broadcast(known) if _few(known) else known, "rep", "left").select(*rest.columns, F.coalesce("component", "rep").alias("part"))
    by_list, by_part = Window.partitionBy("token"), Window.partitionBy("token", "part")
    counted = _alive(labelled, percent).withColumn("crowd", F.count(F.lit(1)).over(by_part))
    hub = F.max(F.struct("crowd", F.xxhash64("token", "sid").alias("any"), "sid", "n", "part")).over(by_list)
    return counted.withColumns({
        "sets": F.count(F.lit(1)).over(by_list),
        "most": F.max("crowd").over(by_list),
        "others": F.count(F.when(F.col("crowd") < BLOCK, 1)).over(by_list),
        "hub": hub,
    }).withColumn("hub", F.struct("hub.sid", "hub.n", "hub.part"))


def _alive(labelled: DataFrame, percent: int) -> DataFrame:
    """Entries whose list holds a set of another component that is near enough in size and has the token early enough."""
    step = _step(F.col("n"), percent)
    early = F.when(~_late(percent), F.col("part"))
    dealt = labelled.select("token", "n", "pos", "part").repartition("token")
    steps = dealt.groupBy("token", step.alias("step")).agg(
        F.min("part").alias("x"), F.max("part").alias("y"), F.min(early).alias("early_x"), F.max(early).alias("early_y")
    )
    beside = F.explode(F.array([F.struct((F.col("step") + d).alias("step"), F.lit(d).alias("from")) for d in (-1, 0, 1)])).alias("of")
    # early sets of its own step and the one below meet any entry, all other sets early ones only
    below = F.col("of.from") >= 0
    around = steps.select("token", beside, "x", "y", "early_x", "early_y").groupBy("token", F.col("of.step").alias("step")).agg(
        F.min("x").alias("x"), F.max("y").alias("y"),
        F.min(F.when(below, F.col("early_x"))).alias("early_x"), F.max(F.when(below, F.col("early_y"))).alias("early_y"),
    )
    around = around.where("x <> y").select(F.col("token").alias("of"), F.col("step").alias("of_step"), "x", "y", "early_x", "early_y")
    # equal steps, said so that the join is by token alone and nothing is dealt again; a list has few steps
    met = labelled.join(around, (F.col("token") == F.col("of")) & (step >= F.col("of_step")) & (step <= F.col("of_step")))
    other = (F.col("x") != F.col("part")) | (F.col("y") != F.col("part"))
    early_other = (F.col("early_x") != F.col("part")) | (F.col("early_y") != F.col("part"))
    return met.where(F.when(_late(percent), F.coalesce(early_other, F.lit(False))).otherwise(other)).select(*labelled.columns)


def _block_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs of the lists' sets in different components, by blocks.

    A list is cut by size steps (linked sets are in one step or in neighbours), by position, by component where one has
    many sets in the list, and by hash into blocks of about `BLOCK` sets: those of one component never meet. In a pair, the token stands early in the smaller set: blocks of later positions meet only early
    ones, never each other. Two blocks are skipped as a whole if their sizes are too far apart or the places of the token
    leave too few tokens for the overlap; what remains is compared set by set with the same tests and by sketch, in arrays:
    only pairs that pass become rows. A pair that is skipped here by position has an earlier common token. Two sets with a common token among the last few before this one have
    met in its list already, as both stand earlier there.
    """
    # a window holds the first places of one set
    before = Window.partitionBy("sid").orderBy("pos")
    entries = entries.withColumns({f"r{k}": F.lag("token", k + 1).over(before) for k in range(RECENT)})
    large = F.col("crowd") >= BLOCK
    lane = F.pmod(F.xxhash64("sid"), F.ceil(F.when(large, F.col("crowd")).otherwise(F.col("others")) / BLOCK))
    lane = F.struct(large.alias("large"), F.when(large, F.col("part")).otherwise(0).alias("of"), lane.alias("at"))
    members = F.struct(*_CARRIED, "pos", "part", "sketch", *[f"r{k}" for k in range(RECENT)])
    placed = entries.withColumns({"step": _step(F.col("n"), percent), "late": _late(percent).cast("int"), "lane": lane})
    placed = placed.withColumn("far", F.floor(F.col("lane.at") / LANES)).repartition("token", "far")
    blocks = placed.groupBy("token", "far", "step", "late", "lane").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.min("pos").alias("first"), F.min("part").alias("p"), F.max("part").alias("q"),
        F.collect_list(members).alias("sets"),
    ).withColumn("key", F.struct("step", "lane"))
    near = F.explode(F.array(F.col("step"), F.col("step") + 1)).alias("near")
    left = blocks.where("late = 0").select("token", near, *[F.col(c).alias(f"l_{c}") for c in ("key", "least", "most", "first", "p", "q", "sets")])
    reach = F.least(F.col("l_most") - F.col("l_first"), F.col("most") - F.col("first"))
    useful = (
        ((F.col("late") == 1) | (F.col("l_key") <= F.col("key")))
        & (F.least("l_most", "most") * 100 >= F.greatest("l_least", "least") * percent)
        & (reach >= _needed(F.col("l_least"), F.col("least"), percent))
        & ~((F.col("l_p") == F.col("q")) & (F.col("l_q") == F.col("p")) & (F.col("p") == F.col("q")))
    )
    both = left.join(blocks, (left["token"] == blocks["token"]) & (F.col("near") == F.col("step")) & useful)
    schema = ", ".join(f"{side}_{c} {kind}" for side in "xy" for c, kind in _CARRIED.items())
    return both.select("l_sets", "sets").mapInArrow(_block_comparer(percent), schema)


#: What a pair carries of each of its sets.
_CARRIED = {"sid": "bigint", "n": "int", "rep": "bigint", "hub": "bigint", "shared": "int", "hub_n": "int"}


def _block_comparer(percent: int):
    """Compares two blocks at a time, all sets of one with all of the other, and gives the pairs that still may link."""

    def numbers(sets: pa.StructArray, name: str, missing: int = 0) -> np.ndarray:
        return sets.field(name).fill_null(missing).to_numpy(zero_copy_only=False).astype(np.int64)

    def open_pairs(a: pa.StructArray, b: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
        a_n, b_n = numbers(a, "n")[:, None], numbers(b, "n")[None]
        need = -((-percent * (a_n + b_n)) // (100 + percent))
        reach = np.minimum(a_n - numbers(a, "pos")[:, None], b_n - numbers(b, "pos")[None])
        open_ = (numbers(a, "part")[:, None] != numbers(b, "part")[None]) & (reach >= need)
        open_ &= np.minimum(a_n, b_n) * 100 >= np.maximum(a_n, b_n) * percent
        i, j = np.nonzero(open_)
        words = [np.frombuffer(b"".join(x.field("sketch").to_pylist()), "<u8").reshape(len(x), -1) for x in (a, b)]
        apart = np.zeros(len(i), np.int64)
        for x, y in zip(words[0].T, words[1].T, strict=True):
            apart += np.bitwise_count(x[i] ^ y[j])
        keep = a_n[i, 0] + b_n[0, j] - apart >= 2 * need[i, j]
        i, j = i[keep], j[keep]
        met = np.zeros(len(i), bool)
        for k in range(RECENT):
            x = numbers(a, f"r{k}", 0)[i]
            for m in range(RECENT):
                met |= x == numbers(b, f"r{m}", 1)[j]
        return i[~met], j[~met]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                a, b = batch.column("l_sets")[row].values, batch.column("sets")[row].values
                i, j = open_pairs(a, b)
                if not len(i):
                    continue
                turned = pa.array(numbers(a, "sid")[i] > numbers(b, "sid")[j])
                ends = {c: (a.field(c).take(pa.array(i)), b.field(c).take(pa.array(j))) for c in _CARRIED}
                x = [pc.if_else(turned, ends[c][1], ends[c][0]) for c in _CARRIED]
                y = [pc.if_else(turned, ends[c][0], ends[c][1]) for c in _CARRIED]
                yield pa.RecordBatch.from_arrays([*x, *y], names=[f"{side}_{c}" for side in "xy" for c in _CARRIED])

    return compare


def _sketches(docs: DataFrame, entries: DataFrame, moved: frozenset[bytes], width: int) -> DataFrame:
    """`sid, sketch` of the sets that have entries: a bit per bucket, whether an odd number of the set's tokens is in it.

    Where the bits of two sets differ, a token of one is not in the other. So sets of sizes a and b whose sketches differ in
    d bits share (a + b - d) / 2 tokens at most, wherever in the sets the different tokens stand.
    """
    wanted = saved(entries.groupBy("sid").agg(F.min("rep").alias("doc_id")), "sketch-ids")
    texts = docs.join(F.broadcast(wanted) if _few(wanted) else wanted, "doc_id").select("sid", "text")
    sent, bits_ = docs.sparkSession.sparkContext.broadcast(moved), ID_BITS

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again = sent.value
        for batch in batches:
            sids, bits = [], []
            for sid, s in zip(batch.column("sid").to_pylist(), shingle_sets(batch.column("text"), width), strict=True):
                print_ = fingerprint(s)
                if _set_number(print_, print_ in again, bits_) == sid & _LOW:  # rows of one doc_id may have several texts
                    odd = np.bincount((s & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
                    sids.append(sid)
                    bits.append(np.packbits(odd.astype(bool)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(bits, pa.binary())], names=["sid", "sketch"])

    return saved(texts.mapInArrow(sketch, "sid bigint, sketch binary").dropDuplicates(["sid"]), "sketches")


def _decided(pairs: DataFrame, percent: int) -> DataFrame:
    """`a, b, state, a_rep, b_rep` of pairs: what the overlaps of both with a common hub already say; 1 linked, 0 not, NULL open.

    With hub h and known overlaps of both sets with it, they share at least o(x) + o(y) - |h| tokens, and at most
    min(o(x), o(y)) inside h and min(|x| - o(x), |y| - o(y)) outside.
    """
    same = F.col("x_hub") == F.col("y_hub")
    need = _needed(F.col("x_n"), F.col("y_n"), percent)
    least = F.col("x_shared") + F.col("y_shared") - F.col("x_hub_n")
    most = F.least("x_shared", "y_shared") + F.least(F.col("x_n") - F.col("x_shared"), F.col("y_n") - F.col("y_shared"))
    state = F.when(same & (least >= need), 1).when(same & (most < need), 0)
    return pairs.groupBy(F.col("x_sid").alias("a"), F.col("y_sid").alias("b")).agg(
        F.max(state).alias("state"), F.min("x_rep").alias("a_rep"), F.min("y_rep").alias("b_rep")
    )


def link_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of `docs` (`doc_id`, `text`): `doc_id, n_shingles, component_id`.

    A set is the distinct shingles of `width` lower-cased words; sets link when 100 times their intersection is at least
    `percent` times their union. `component_id` is the smallest doc_id that links lead to, its own included. Shingles are
    64-bit numbers, so two different ones are taken for the same with a chance of about 2**-64 a pair. NULL, empty and
    blank texts have no shingles and link with nothing. Rows of one doc_id are one document that has the links of all of
    them; rows without doc_id keep a NULL component and give no links. An empty table gives an empty table; other columns
    are ignored.

    How: equal sets become one. Every set enters an index with its first tokens in an order that puts frequent tokens
    last. In each index list one hub, the set with the most common tokens, is compared with the others; lists whose sets
    are in one component after that are done, so a group of near copies costs its size, not its square. While many pairs
    are left, each list gets another hub, any set of its largest component: a family whose members link with some of the
    others only, and not with the first hub, grows together that way. For what is left the first hub's answers are used again: pairs that overlaps with a common hub decide are not compared, and blocks of
    a list that cannot reach the overlap by size or position are skipped. Pairs whose first places have too few tokens in
    common are dropped before texts are fetched. The rest is compared in full.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = saved(_own_sets(docs, width), "sets")
    sets = own.where("n > 0 AND doc_id IS NOT NULL").groupBy("print").agg(
        F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.first("low").alias("low"), F.first("low2").alias("low2")
    )
    classes, moved = _numbered(saved(sets, "set-classes"))
    known = docs.where("doc_id IS NOT NULL")
    index = _index(known, width, percent, _frequent(_counted(known, width, percent)), moved)
    index = saved(_shared_only(index), "index")
    prefixes = saved(_prefixes(index), "prefixes")

    tested, parts = None, None
    entries, size, before = index, index.count(), float("inf")
    for turn in range(HUB_ROUNDS):
        pairs = saved(_promising(_hub_pairs(entries, percent), prefixes, percent), f"hub{turn}-pairs")
        found = _overlaps(docs, pairs, width, f"hub{turn}")
        tested = found if tested is None else tested
        parts = _joined(parts, _links(found, percent))
        entries = saved(_left(entries, parts, percent), f"left{turn}")
        now = _open_pairs(entries)
        if now <= OPEN * size or now > before / 2:
            break
        before = now
    if not entries.isEmpty():
        best = tested.groupBy(F.col("b").alias("sid")).agg(F.max(F.struct("overlap", "a", "a_n")).alias("best"))
        sketched = entries.drop("hub").join(_sketches(known, entries, moved, width), "sid").join(best, "sid", "left").select(
            "token", "sid", "n", "pos", "rep", "part", "crowd", "others", "sketch",
            F.col("best.a").alias("hub"), F.col("best.overlap").alias("shared"), F.col("best.a_n").alias("hub_n"),
        )
        decided = saved(_decided(_block_pairs(sketched, percent), percent), "decided")
        open_ = saved(_promising(decided.where("state IS NULL").select("a", "b"), prefixes, percent), "rest-pairs")
        sure = decided.where("state = 1").select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"))
        parts = _joined(parts, _links(_overlaps(docs, open_, width, "rest"), percent).union(sure))
    of_print = classes.join(parts, classes["rep"] == parts["id"], "left").select(
        F.col("print").alias("of"), F.coalesce("component", "rep").alias("of_component")
    )
    found = own.join(of_print, own["print"] == of_print["of"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") > 0, F.col("of_component")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.cast("long").alias("component_id"))


def _joined(parts: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components of further links between sets that are in components already."""
    return connected_components(links if parts is None else links.union(parts.select(F.col("id").alias("a"), F.col("component").alias("b"))))


def _shared_only(index: DataFrame) -> DataFrame:
    """Entries of tokens that two different sets have; equal sets count as one, and the first of their documents stands for them.

    `part` is that document, as no links are known; `sets` counts the list's sets and `hub` is the one that comes last.
    """
    by_list = Window.partitionBy("token")
    shared = index.withColumns({"first": F.min("sid").over(by_list), "last": F.max("sid").over(by_list)}).where("first <> last")
    once = shared.groupBy("token", "sid").agg(*[F.min(c).alias(c) for c in ("n", "pos", "rep")]).withColumn("part", F.col("rep"))
    return once.withColumns({"sets": F.count(F.lit(1)).over(by_list), "hub": F.max(F.struct("sid", "n", "part")).over(by_list)})
