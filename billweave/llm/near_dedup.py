"""Near-duplicate documents by a signature-coordinate inverted join.

A document is the set of its 5-word shingles. Documents with one set are one class, and only
classes are compared. A signature has ``COORDINATES`` minimum hashes; a class is
posted under each of its first ``POSTED`` coordinate-value pairs. Two sets of similarity
0.75 have none of these in common, or fewer than ``LEAST_MATCHES`` of all coordinates, with a
probability of a few in a million.

1. Each list has a centre: the class most like the list's usual coordinates, which a hash
   sample of its members shows. It is compared with all others by counting equal coordinates
   (eight bits of each travel with a posting), and every class is linked to the best of its
   lists' centres if the full sets confirm it. That settles large groups of near copies with
   one link a member: copies of one text are more like that text than like each other.
2. Lists that lie within one component by then are skipped. In the others all members of
   different components are compared, in blocks and by many more coordinates, and pairs with
   enough matches are confirmed too. In lists of more than ``LONG_LIST`` members the full sets meet at once.

Components come from the confirmed links by alternating stars. Links, lists and sets stay in
tables; first classes and list sizes are found by map-side combined aggregates.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billweave.llm.text import LOWER, NOT_SPACE, Rolling, mix, text_slices, word_hashes, word_spans
from billweave.session import cut_lineage

SHINGLE = 5
PERCENT = 75
COORDINATES, POSTED, LEAST_MATCHES = 512, 10, 338
SHORT, LEAST_SHORT_MATCHES, CENTRE_SAMPLE = 48, 22, 48
BLOCK = 2_000
LONG_LIST, BLOCK_SHINGLES = 256, 500_000
PIVOT_SHARE = 5_000
_LAST = (1 << 63) - 1
_ODD = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle fingerprints of all rows, and the rows' offsets in them; A-Z lowered."""
    data = LOWER[data]
    starts, ends, at = word_spans(data, offsets, NOT_SPACE)
    rolling = Rolling(word_hashes(data, starts, ends))
    n = np.diff(at)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), count)
    first = np.arange(len(row)) - np.repeat(np.concatenate(([0], np.cumsum(count)[:-1])), count) + at[row]
    prints = rolling.of(first, np.minimum(first + width, at[row + 1]))
    order = np.lexsort((prints, row))
    prints, row = prints[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (prints[1:] != prints[:-1]) | (row[1:] != row[:-1])
    prints, row = prints[new], row[new]
    return prints, np.searchsorted(row, np.arange(len(n) + 1))


_SKETCH = "doc long, key int, n long, s1 long, s2 long, posted binary, sketch binary"


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """Of docs (doc, key, text): set size, a 128-bit name of the set, posted coordinates and eight bits of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            prints, at = shingle_sets(part.data, part.offsets, width)
            rows = np.flatnonzero(np.diff(at))
            head = at[:-1][rows]
            least = np.zeros((len(at) - 1, COORDINATES), np.uint32)
            names = np.zeros((2, len(at) - 1), np.uint64)
            if len(rows):
                for c in range(COORDINATES):
                    least[rows, c] = np.minimum.reduceat(prints * _ODD[c], head) >> np.uint64(32)
                names[0, rows] = np.add.reduceat(mix(prints ^ np.uint64(0x1B873593)), head)
                names[1, rows] = np.add.reduceat(mix(prints ^ np.uint64(0x85EBCA6B)), head)
            posted, short = np.ascontiguousarray(least[:, :POSTED]), (mix(least.astype(np.uint64)) & np.uint64(255)).astype(np.uint8)
            columns = [part.rows.column("doc"), part.rows.column("key"), pa.array(np.diff(at)), *[pa.array(x.view(np.int64)) for x in names]]
            columns += [pa.array([r.tobytes() for r in x], pa.binary()) for x in (posted, short)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _SKETCH.split(", ")])

    return docs.mapInArrow(run, _SKETCH)


def _postings(classes: DataFrame) -> DataFrame:
    """list (coordinate and value as one long), node, and the first coordinates of its sketch."""
    value = lambda c: F.conv(F.hex(F.substring("posted", 4 * c + 1, 4)), 16, 10).cast("long") + F.lit(c << 32)
    lists = F.explode(F.array(*[value(c) for c in range(POSTED)]))
    return classes.select("node", F.substring("sketch", 1, SHORT).alias("sketch"), lists.alias("list"))


def _matrix(sketches: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), np.uint8).reshape(-1, width)


_NODE = "struct<doc:long,key:int>"


def _centres(postings: DataFrame) -> DataFrame:
    """list, centre (node and sketch): of three or fewer members the first, else the one most like the usual coordinates.

    What is usual comes from a hash sample of about ``CENTRE_SAMPLE`` members; all members are
    compared with it, in the tasks, and the best is a map-side combined minimum.
    """
    sizes = postings.groupBy("list").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    placed = postings.join(sizes, "list")
    part = F.pmod(F.xxhash64("node", "list"), F.lit(1 << 20)) * F.col("_n") < CENTRE_SAMPLE * (1 << 20)
    samples = placed.where((F.col("_n") > 3) & part).groupBy("list").agg(F.collect_list("sketch").alias("_some"))

    def usual(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offset = np.arange(SHORT) * 256
        for batch in batches:
            out = []
            for some in batch.column("_some"):
                seen = _matrix(some.values, SHORT)
                out.append(np.bincount((seen + offset).ravel(), minlength=256 * SHORT).reshape(SHORT, 256).argmax(axis=1).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("list"), pa.array(out, pa.binary())], names=["list", "usual"])

    known = placed.join(samples.mapInArrow(usual, "list long, usual binary"), "list", "left").select("list", "node", "sketch", F.coalesce("usual", "sketch").alias("usual"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unlike = (_matrix(batch.column("sketch"), SHORT) != _matrix(batch.column("usual"), SHORT)).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("list"), pa.array(unlike.astype(np.int32)), batch.column("node"), batch.column("sketch")], names=["list", "unlike", "node", "sketch"])

    compared = known.mapInArrow(compare, f"list long, unlike int, node {_NODE}, sketch binary")
    return compared.groupBy("list").agg(F.min(F.struct("unlike", "node", "sketch")).alias("centre"))


def first_candidates(postings: DataFrame) -> DataFrame:
    """node, target: for each class the best match among the centres of its lists, if it is good enough."""
    joined = postings.join(_centres(postings), "list").where(F.col("node") != F.col("centre.node"))
    rows = joined.select("node", "sketch", F.col("centre.node").alias("target"), F.col("centre.sketch").alias("other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                matches = (_matrix(batch.column("sketch"), SHORT) == _matrix(batch.column("other"), SHORT)).sum(axis=1)
                good = pa.array(matches >= LEAST_SHORT_MATCHES)
                columns = [batch.column("node"), batch.column("target"), pa.array(matches.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([c.filter(good) for c in columns], names=["node", "target", "matches"])

    found = rows.mapInArrow(run, f"node {_NODE}, target {_NODE}, matches int")
    # most matches first, then the smallest target
    order = F.struct((-F.col("matches")).alias("fewer"), F.col("target").alias("target"))
    return found.groupBy("node").agg(F.min(order).alias("best")).select("node", F.col("best.target").alias("target"))


def open_lists(postings: DataFrame, classes: DataFrame, components: DataFrame) -> DataFrame:
    """The lists with members of more than one component: list, members, shingles (of all their sets)."""
    placed = postings.select("list", "node").join(components, "node").join(classes.select("node", "n"), "node")
    lists = placed.groupBy("list").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"), F.min("component").alias("_a"), F.max("component").alias("_b"))
    return lists.where("_a < _b").select("list", "members", "shingles")


def _dealt(members: DataFrame, blocks: Column, *columns: str) -> DataFrame:
    """Members of lists of several blocks, each to every pair of blocks that has its own."""
    own = members.withColumn("_blocks", blocks.cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    partner = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    return own.withColumn("_with", partner).select("list", F.least("own", "_with").alias("one"), F.greatest("own", "_with").alias("two"), "own", "node", "component", *columns)


def second_candidates(postings: DataFrame, classes: DataFrame, components: DataFrame, lists: DataFrame) -> DataFrame:
    """node, target: all pairs of one list (of those given), of different components and with enough matches."""
    members = postings.select("list", "node").join(lists, "list").join(components, "node").join(classes.select("node", "posted", "sketch"), "node")
    dealt = _dealt(members, F.ceil(F.col("members") / BLOCK), "posted", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        key = np.stack([table.column(c).to_numpy() for c in ("list", "one", "two")])
        order = np.lexsort(key[::-1])
        key = key[:, order]
        sketch = _matrix(table.column("sketch"), COORDINATES)[order]
        posted = np.frombuffer(b"".join(table.column("posted").to_pylist()), np.uint32).reshape(-1, POSTED)[order]
        own, node = table.column("own").to_numpy()[order], table.column("node").combine_chunks().take(pa.array(order))
        part_of = table.column("component").combine_chunks()
        component = np.unique(np.stack([part_of.field("doc").to_numpy(), part_of.field("key").to_numpy().astype(np.int64)]), axis=1, return_inverse=True)[1].reshape(-1)[order]
        edges = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0), [True])))
        left, right = [], []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if component[a:b].min() == component[a:b].max():
                continue
            across = key[1, a] != key[2, a]
            rows = np.flatnonzero(own[a:b] == key[1, a]) + a
            others = np.flatnonzero(own[a:b] == key[2, a]) + a if across else rows
            for at in range(0, len(rows), 256):
                mine = rows[at : at + 256]
                differ = component[mine][:, None] != component[others][None, :]
                if not across:
                    differ &= mine[:, None] < others[None, :]
                x, y = np.nonzero(differ)
                for k in range(0, len(x), 1 << 15):
                    p, q = mine[x[k : k + (1 << 15)]], others[y[k : k + (1 << 15)]]
                    # a pair is looked at in the first list it has in common
                    here = (posted[p] == posted[q]).argmax(axis=1) == key[0, a] >> 32
                    p, q = p[here], q[here]
                    good = (sketch[p] == sketch[q]).sum(axis=1) >= LEAST_MATCHES
                    left.append(p[good])
                    right.append(q[good])
        if left:
            pair = np.unique(np.stack([np.concatenate(left), np.concatenate(right)]), axis=1)
            for k in range(0, pair.shape[1], 50_000):
                p, q = [pa.array(x[k : k + 50_000]) for x in pair]
                yield pa.RecordBatch.from_arrays([node.take(p), node.take(q)], names=["p", "q"])

    pairs = dealt.repartition("list", "one", "two").mapInArrow(run, f"p {_NODE}, q {_NODE}")
    return pairs.select(F.greatest("p", "q").alias("node"), F.least("p", "q").alias("target")).where(F.col("node") != F.col("target")).distinct()


def long_list_links(docs: DataFrame, postings: DataFrame, classes: DataFrame, components: DataFrame, lists: DataFrame, width: int, percent: int) -> DataFrame:
    """node, target: links between components inside long lists, by full sets.

    In a long list even pairs that only might be similar are too many to be told. Here the sets themselves meet, in blocks of at most
    ``BLOCK_SHINGLES`` shingles; a block counts the shingles a member shares with all members of other
    components at once, joins components as it finds links, and tells the links that joined two: fewer than it has members.
    """
    members = postings.select("list", "node").join(lists, "list").join(components, "node").join(classes.select("node", "posted"), "node")
    needed = members.select(F.col("node.doc").alias("doc"), F.col("node.key").alias("key")).distinct()
    texts = docs.select("doc", "key", "text").join(needed.hint("shuffle_hash"), ["doc", "key"])

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            prints, at = shingle_sets(part.data, part.offsets, width)
            node = pa.StructArray.from_arrays([part.rows.column("doc"), part.rows.column("key")], names=["doc", "key"])
            yield pa.RecordBatch.from_arrays([node, pa.array([prints[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())], names=["node", "prints"])

    sets = texts.mapInArrow(to_sets, f"node {_NODE}, prints binary").groupBy("node").agg(F.first("prints").alias("prints"))
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES))
    dealt = _dealt(members.join(sets, "node"), blocks, "posted", "prints")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ("list", "one", "two")):
            links = _joining_links(rows, percent)
            if len(links):
                node = rows.column("node").combine_chunks()
                yield pa.RecordBatch.from_arrays([node.take(pa.array(links[:, k])) for k in range(2)], names=["p", "q"])

    found = dealt.repartition("list", "one", "two").sortWithinPartitions("list", "one", "two").mapInArrow(run, f"p {_NODE}, q {_NODE}")
    return found.select(F.greatest("p", "q").alias("node"), F.least("p", "q").alias("target")).distinct()


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Neighbouring rows of one key, one group at a time, out of sorted batches."""
    held: list[pa.RecordBatch] = []
    name = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy() for k in keys])
        edges = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            if held and tuple(key[:, a]) != name:
                yield pa.Table.from_batches(held)
                held = []
            name = tuple(key[:, a])
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _joining_links(rows: pa.Table, percent: int) -> np.ndarray:
    """Pairs of rows whose sets are similar enough and whose components were apart until then."""
    part = rows.column("component").combine_chunks()
    _, group = np.unique(np.stack([part.field("doc").to_numpy(), part.field("key").to_numpy().astype(np.int64)]), axis=1, return_inverse=True)
    group = group.reshape(-1)
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("prints").combine_chunks()]
    size = np.array([len(x) for x in sets])
    at = np.concatenate(([0], np.cumsum(size)))
    vocabulary, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ids = ids.reshape(-1)
    row_of = np.repeat(np.arange(len(sets)), size)
    posted = np.frombuffer(b"".join(rows.column("posted").to_pylist()), np.uint32).reshape(-1, POSTED)
    coordinate, own = rows.column("list")[0].as_py() >> 32, rows.column("own").to_numpy()
    one, two = rows.column("one")[0].as_py(), rows.column("two")[0].as_py()
    mark, links = np.zeros(len(vocabulary), bool), []
    for i in np.flatnonzero(own == one).tolist():
        others = (own == two) & (group != group[i])
        # a pair is looked at in the first list it has in common
        others &= (posted == posted[i]).argmax(axis=1) == coordinate
        if one == two:
            others[: i + 1] = False
        if not others.any():
            continue
        mark[ids[at[i] : at[i + 1]]] = True
        common = np.bincount(row_of[mark[ids]], minlength=len(sets))
        mark[ids[at[i] : at[i + 1]]] = False
        for j in np.flatnonzero(others & (100 * common >= percent * (size + size[i] - common))).tolist():
            if group[i] != group[j]:
                links.append((i, j))
                group[group == group[j]] = group[i]
    return np.array(links, np.int64).reshape(-1, 2)


def confirmed(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (node, target) whose full sets are similar enough.

    Sets go to their pair's target; a target of many pairs is dealt over as many shares as it
    takes, its set to each of them.
    """
    shares = pairs.groupBy("target").agg(F.ceil(F.count(F.lit(1)) / PIVOT_SHARE).cast("int").alias("_shares"))
    members = pairs.join(shares, "target").select("node", "target", F.pmod(F.xxhash64("node"), F.col("_shares")).cast("int").alias("share"), F.lit(1).alias("role"))
    heads = shares.select(F.col("target").alias("node"), "target", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)).alias("share"), F.lit(0).alias("role"))
    needed = members.unionByName(heads).select(F.col("node.doc").alias("doc"), F.col("node.key").alias("key"), "target", "share", "role")
    # one row per document that is needed, whatever the number of its repeats
    joined = docs.select("doc", "key", "text").join(needed.groupBy("doc", "key").agg(F.collect_list(F.struct("target", "share", "role")).alias("uses")).hint("shuffle_hash"), ["doc", "key"])

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            prints, at = shingle_sets(part.data, part.offsets, width)
            uses = part.rows.column("uses")
            n = np.diff(uses.offsets.to_numpy())
            own, row = uses.flatten(), np.repeat(np.arange(len(n)), n)
            sets = [prints[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            for k in range(0, len(row), 2_000):
                some, which = own.slice(k, 2_000), row[k : k + 2_000]
                columns = [some.field("target"), some.field("share"), some.field("role"), part.rows.column("doc").take(pa.array(which)), part.rows.column("key").take(pa.array(which)), pa.array([sets[i] for i in which], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["target", "share", "role", "doc", "key", "prints"])

    sets = joined.mapInArrow(to_sets, f"target {_NODE}, share int, role int, doc long, key int, prints binary")
    sorted_ = sets.repartition("target", "share").sortWithinPartitions("target", "share", "role")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, head_set = None, None
        for batch in batches:
            target, role = batch.column("target"), batch.column("role").to_numpy()
            docs_, keys = target.field("doc").to_numpy(), target.field("key").to_numpy()
            good = np.zeros(batch.num_rows, bool)
            for i, prints in enumerate(batch.column("prints")):
                own = np.frombuffer(prints.as_buffer(), np.uint64)
                name = (docs_[i], keys[i])
                if role[i] == 0:
                    head, head_set = name, own
                elif name == head:
                    common = len(np.intersect1d(own, head_set, assume_unique=True))
                    good[i] = common > 0 and 100 * common >= percent * (len(own) + len(head_set) - common)
            keep = pa.array(good)
            node = pa.StructArray.from_arrays([batch.column("doc").filter(keep), batch.column("key").filter(keep)], names=["doc", "key"])
            yield pa.RecordBatch.from_arrays([node, target.filter(keep)], names=["node", "target"])

    return sorted_.mapInArrow(compare, f"node {_NODE}, target {_NODE}").distinct()


# ---- components


def star_components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of any links, for every node of a link: large and small stars in turn."""
    edges = cut_lineage(links.select(F.greatest("node", "target").alias("v"), F.least("node", "target").alias("u")).where(F.col("u") < F.col("v")).distinct())
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v"), F.col("m").alias("u")).where(F.col("u") < F.col("v")).distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(least, "v")
        small = joined.select(F.col("u").alias("v"), F.col("m").alias("u")).union(joined.select("v", F.col("m").alias("u"))).where(F.col("u") < F.col("v")).distinct()
        new = cut_lineage(small)
        # at rest every node is linked to the root of its star only, so nothing changes any more
        if new.count() == edges.count() and new.join(edges, ["u", "v"], "left_anti").limit(1).count() == 0:
            return new.select(F.col("v").alias("node"), F.col("u").alias("component"))
        edges = new


def _component_of(classes: DataFrame, first: DataFrame) -> DataFrame:
    """Every class with its component; those without links are their own."""
    return classes.select("node").join(first, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, percent: int = PERCENT, long_list: int | None = None) -> DataFrame:
    """One row per row: doc, key (the row's node), n_shingles, component (the smallest node reachable).

    ``long_list`` (``LONG_LIST``): members from which on a list's pairs are not told, but joined where its sets meet; no link is lost either way.
    """
    keyed = keyed_documents(docs, doc_id, text)
    rows = cut_lineage(sketches(keyed, width).withColumn("node", F.struct("doc", "key")))
    classes = cut_lineage(rows.where("n > 0").groupBy("s1", "s2").agg(F.min(F.struct("node", "n", "posted", "sketch")).alias("_c")).select("s1", "s2", "_c.node", "_c.n", "_c.posted", "_c.sketch"))
    postings = _postings(classes)
    first = cut_lineage(first_candidates(postings))
    links = cut_lineage(confirmed(keyed, first, width, percent))
    components = cut_lineage(_component_of(classes, star_components(links)))
    lists = cut_lineage(open_lists(postings, classes, components))
    long_list = LONG_LIST if long_list is None else long_list
    long = lists.where(F.col("members") > long_list)
    second = cut_lineage(second_candidates(postings, classes, components, lists.where(F.col("members") <= long_list)))
    found = [confirmed(keyed, second, width, percent)] if second.limit(1).count() else []
    if long.limit(1).count():
        found.append(long_list_links(keyed, postings, classes, components, long, width, percent))
    if found:
        more = cut_lineage(found[0] if len(found) == 1 else found[0].unionByName(found[1]))
        of = lambda c: components.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
        between = more.join(of("node"), "node").join(of("target"), "target").select(F.col("_node").alias("node"), F.col("_target").alias("target"))
        merged = star_components(between).select(F.col("node").alias("component"), F.col("component").alias("_root"))
        components = components.join(merged, "component", "left").select("node", F.coalesce("_root", "component").alias("component"))
    named = classes.select("s1", "s2", "node").join(components, "node").select("s1", "s2", "component")
    joined = rows.select("doc", "key", "n", "s1", "s2").join(named, ["s1", "s2"], "left")
    return joined.select("doc", "key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.struct("doc", "key")).alias("component"))


def keyed_documents(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc (null becomes the largest long), key that tells rows of one id apart by their text, text."""
    return docs.select(_doc(F.col(doc_id)).alias("doc"), _key(F.col(text)).alias("key"), F.col(text).alias("text"))


def _doc(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(_LAST))


def _key(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit((1 << 31) - 1)).cast("int")


def component_report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row: doc_id, n_shingles, component_id, kept.

    A null or empty text has no shingles and is its own component. A null id comes after all
    others and names no component but its own. Rows with one id and equal texts are alike.
    """
    found = near_duplicates(docs, doc_id=doc_id, text=text, width=width, percent=percent)
    real = lambda c: F.when(c != _LAST, c)
    out = found.select(real(F.col("doc")).alias("doc_id"), "n_shingles", real(F.col("component.doc")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The first document of every component, unchanged, and all without shingles; of rows with one id and text, one."""
    found = near_duplicates(docs, doc_id=doc_id, text=text, width=width, percent=percent)
    per_row = found.groupBy("doc", "key").agg(F.count(F.lit(1)).alias("_n"), F.first("component").alias("_c"), F.first("n_shingles").alias("_s"))
    kept = cut_lineage(per_row.where(F.struct("doc", "key") == F.col("_c")).select("doc", "key", ((F.col("_n") > 1) & (F.col("_s") > 0)).alias("repeated")))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _doc(F.col(doc_id)).alias("doc"), _key(F.col(text)).alias("key"))
    joined = whole.join(kept.hint("shuffle_hash"), ["doc", "key"])
    single = joined.where("not repeated")
    repeated = joined.where("repeated").dropDuplicates(["doc", "key"])
    return single.unionByName(repeated).select("row.*")
