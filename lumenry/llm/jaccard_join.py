"""N-gram Jaccard join through a token-group matrix.

Documents are sets of five-word shingles; two are linked at a Jaccard
similarity of 0.8 or more, and the join gives the connected components.

1. Document frequencies of all shingles are exchanged between blocks and shards
   (module exchange); they may be too high, which costs time only, but never too
   low.  A document of which more than a fifth of the shingles are its own
   cannot be linked, and leaves.  Equal sets become one class.
2. A linked pair shares one of its rarest shingles (the prefix: what a set may
   lack, and one more).  Classes are partitioned into groups of similar ones:
   a family is what reaches the same least class through a prefix shingle, and
   is cut into groups of about ``GROUP`` by hash.  The matrix has a row for
   each shingle and group in which it is some member's prefix.
3. Every class is held against its own group, then against one other group of
   its family (groups stand in a binary tree), and components are formed.
4. Then each class queries every group that shares a prefix shingle with it and
   has members of a component that ranks higher; a pair of components is held
   together from one side only.  A group is opened only where its token union
   could hold enough of the query's set; then overlaps with all members are
   counted.  What is not queried is in the same component already, or shares no
   prefix and so cannot be linked; components are exact.

Groups emit spanning links, never all pairs.  A group's members, and the batches
of queries held against it, are bounded in number and in shingles (one set alone
may be larger).  Equal sets of a block are sent once, and what many rows share
meets them in a broadcast of at most ``OFTEN`` classes.

Results: a null or empty text, or one without words, has an empty set and only
itself; one with fewer than five words is one shingle of them all.  Whole texts
are read, however long.  Ties need no rule: a similarity of exactly 0.8 links.
Rows that repeat an id and a text are worked on once and returned as often as
they came; rows that repeat an id with another text are documents of their own.
A component's id is its smallest doc_id; rows without doc_id take part, and have
it as well (null, if no row of theirs has one).  An empty table gives an empty
one.  Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .textkit import LOWER, NOT_SPACE, Words, distinct, mix, pieces, shingles, text_buffer, unused
from .workspace import tidied, written

WORDS = 5
PERCENT = 80
GROUP = 256
BATCH = 512
#: Shingles of a group, and of a batch of queries.
TOKENS = 1 << 18
#: Rows of ids that are sent to every executor at most; more meet the other side in a shuffle.
SENT = 250_000
#: A class with this share of the rows meets them in a broadcast; so there are no more of those than the divisor.
OFTEN = 1_000


def _sets(column: pa.ChunkedArray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, row) of a column of texts, by row."""
    flat, offsets = text_buffer(column)
    hashes, rows = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    for a, b in pieces(offsets):
        h, r, _ = shingles(Words(flat, offsets[a : b + 1], NOT_SPACE, LOWER), k)
        h, r = distinct(h, r)
        hashes.append(h)
        rows.append(r + a)
    return np.concatenate(hashes), np.concatenate(rows)


def _code(df: np.ndarray) -> np.ndarray:
    """A document frequency in a byte: exact below 128, then sixteenths of an octave."""
    high = 128 + np.floor(16 * np.log2(np.maximum(df, 128) / 128))
    return np.where(df < 128, df, np.minimum(high, 255)).astype(np.uint8)


def _keys(table: pa.Table, hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """(distinct keys, inverse, counts); a row counts as often as it came.  No inverse where no row came twice."""
    copies = table.column("copies").to_numpy()
    if (copies == 1).all():
        keys, counts = np.unique(hashes, return_counts=True)
        return keys, None, counts
    keys, inverse = np.unique(hashes, return_inverse=True)
    return keys, inverse, np.bincount(inverse, copies[row], minlength=len(keys)).astype(np.int64)


def _ask(k: int, shards: int):
    def run(key, table):
        hashes, row = _sets(table.column("text"), k)
        keys, _, counts = _keys(table, hashes, row)
        del hashes, row
        order, cuts = exchange.by_shard(keys, shards)
        keys, counts = keys[order], counts[order]
        full = [s for s in range(shards) if cuts[s + 1] > cuts[s]]
        blobs = [exchange.pack(keys[cuts[s] : cuts[s + 1]], counts[cuts[s] : cuts[s + 1]]) for s in full]
        return pa.table({"shard": pa.array(full, pa.int64()), "block": pa.array([key[0].as_py()] * len(full), pa.int64()), "data": pa.array(blobs, pa.binary())})

    return run


def _answer(key, table):
    asked = [exchange.unpack(b) for b in table.column("data").to_pylist()]
    keys = np.concatenate([k for k, _ in asked])
    counts = np.concatenate([c for _, c in asked])
    unique, inverse = np.unique(keys, return_inverse=True)
    code = _code(np.bincount(inverse, counts, minlength=len(unique)).astype(np.int64))[inverse]
    cuts = np.cumsum([0, *(len(k) for k, _ in asked)])
    blobs = [code[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table({"block": table.column("block"), "shard": table.column("shard"), "data": pa.array(blobs, pa.binary())})


_SETS = "doc_id long, text_hash long, copies long, n_shingles long, node binary, shingles binary, prefix array<long>"
_SETS_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("copies", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.binary()), ("shingles", pa.binary()), ("prefix", pa.list_(pa.int64()))]
)


def _least_shared(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * n // 100)


def _resolve(k: int, shards: int, percent: int):
    def run(key, docs, answers):
        rows = docs.num_rows
        hashes, row = _sets(docs.column("text"), k)
        same = [docs.column(c).combine_chunks() for c in ("doc_id", "text_hash", "copies")]
        unique, inverse, counts = _keys(docs, hashes, row)
        del docs
        order, cuts = exchange.by_shard(unique, shards)
        code = np.zeros(len(unique), dtype=np.uint8)
        for shard, data in zip(answers.column("shard").to_pylist(), answers.column("data").to_pylist(), strict=True):
            mine = order[cuts[shard] : cuts[shard + 1]]
            code[mine[exchange.packed_order(counts[mine])]] = np.frombuffer(data, np.uint8)
        del order, counts, answers
        df = code[np.searchsorted(unique, hashes) if inverse is None else inverse]
        del unique, inverse
        n = np.bincount(row, minlength=rows)
        own = np.bincount(row[df == 1], minlength=rows)
        first = np.searchsorted(row, np.arange(rows + 1))
        need = _least_shared(n, percent)
        nodes, sets, prefixes, met = [None] * rows, [None] * rows, [None] * rows, set()
        for i in np.flatnonzero((n > 0) & (n - own >= need)):
            mine = hashes[first[i] : first[i + 1]]
            sums = mix(mine).sum(dtype=np.uint64), mix(mine ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
            nodes[i] = sums[0].tobytes() + sums[1].tobytes()
            if nodes[i] in met:  # a block sends a set once, whatever copies it holds
                continue
            met.add(nodes[i])
            often = df[first[i] : first[i + 1]]
            rarest = np.lexsort((mine, often))[: n[i] - need[i] + 1]
            sets[i], prefixes[i] = mine.tobytes(), mine[rarest[often[rarest] > 1]].view(np.int64).tolist()
        return pa.table([*same, pa.array(n), pa.array(nodes, pa.binary()), pa.array(sets, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))], schema=_SETS_SCHEMA)

    return run


def resolved_sets(docs: DataFrame, *, k: int = WORDS, percent: int = PERCENT, block_bytes: int = exchange.BLOCK_BYTES) -> DataFrame:
    """A row for each distinct (doc_id, text): text_hash, copies, n_shingles, and for
    documents that could be linked node, the set's signature; shingles and prefix stand
    on one row at least of each node.  Written to the shared folder."""
    base = exchange.distinct_rows(docs).withColumn("text_hash", F.xxhash64("text"))
    n = exchange.parts(base, block_bytes)
    dealt = base.withColumn("block", exchange.block_of(n))
    asked = dealt.groupBy("block").applyInArrow(_ask(k, n), "shard long, block long, data binary")
    answers = asked.groupBy("shard").applyInArrow(_answer, "block long, shard long, data binary")
    out = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_resolve(k, n, percent), _SETS)
    return written(out, "jaccard-sets", keep=True)


class _Forest:
    """Components of some places."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def link(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


class Group:
    """Members' sets, as the union of their tokens with a list of members each."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(s) for s in sets], dtype=np.int64)
        tokens = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
        member = np.repeat(np.arange(len(sets)), self.n)
        order = np.argsort(tokens, kind="stable")
        self.member = member[order]
        self.union, self.first = np.unique(tokens[order], return_index=True)
        self.first = np.append(self.first, len(order))

    def links(self, sets: list[np.ndarray], percent: int):
        """(query, member) pairs at the threshold; opened where the union holds enough."""
        for q, tokens in enumerate(sets):
            if not len(self.union):
                return
            at = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
            at = at[self.union[at] == tokens]
            if 100 * len(at) < percent * len(tokens):  # the bound: no member can hold enough
                continue
            many = self.first[at + 1] - self.first[at]
            place = np.repeat(self.first[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            shared = np.bincount(self.member[place], minlength=len(self.n))
            for m in np.flatnonzero(100 * shared >= percent * (len(tokens) + self.n - shared)):
                yield q, int(m)


def _sets_of(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in table.column("shingles").to_pylist()]


_LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _own_group(percent: int):
    """Links inside a group: a spanning forest."""

    def run(key, table):
        names, sets = table.column("node").to_pylist(), _sets_of(table)
        forest, out = _Forest(len(sets)), []
        for q, m in Group(sets).links(sets, percent):
            if forest.link(q, m):
                out.append({"a": names[q], "b": names[m]})
        return pa.Table.from_pylist(out, schema=_LINKS)

    return run


def _other_group(percent: int):
    """Links between queries and members: a spanning forest of components."""

    def run(key, queries, members):
        names = members.column("node").to_pylist()
        group, sets = Group(_sets_of(members)), _sets_of(queries)
        asking, out, seen = queries.column("node").to_pylist(), [], {}
        comps = [seen.setdefault(c, len(seen)) for c in [*queries.column("comp").to_pylist(), *members.column("comp").to_pylist()]]
        forest = _Forest(len(seen))
        for q, m in group.links(sets, percent):
            if forest.link(comps[q], comps[len(sets) + m]):
                out.append({"a": asking[q], "b": names[m]})
        return pa.Table.from_pylist(out, schema=_LINKS)

    return run


def components(nodes: DataFrame, links: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, comp): comp is the least node that links reach.  Labels fall along
    links and jump over labels, so the rounds grow with the log of a path.
    rows: how many nodes there are at most, for the size of the files."""
    label = nodes.select("node", F.col("node").alias("comp"))
    if links.isEmpty():
        return label
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links", rows)
    while True:
        fell = both.join(label, both.a == label.node).groupBy(both.b.alias("node")).agg(F.min("comp").alias("least"))
        fallen = label.join(fell, "node", "left").select("node", "comp", F.least("comp", "least").alias("now"))
        # a label's own label: what any of its bearers has heard of
        heard = fallen.groupBy("comp").agg(F.min("now").alias("now"))
        roots = heard.select(F.col("comp").alias("root"), F.col("now").alias("top"))
        jumped = fallen.join(roots, fallen.now == roots.root, "left").select("node", "comp", F.least("now", "top").alias("next"))
        round_ = written(jumped, "labels", rows)
        label = round_.select("node", F.col("next").alias("comp"))
        if round_.where("next < comp").isEmpty():
            return label


def _comparable(low: str, high: str, n: str, percent: int):
    """Sizes that the threshold allows: some size from low to high is near enough to n."""
    return (100 * F.col(high) >= percent * F.col(n)) & (percent * F.col(low) <= 100 * F.col(n))


def _cuts(n: str, many: int):
    """Parts that a group of rows makes, with ``many`` rows and ``TOKENS`` shingles each."""
    return F.greatest(F.ceil(F.count("*") / many), F.ceil(F.sum(n) / TOKENS))


def linked_components(sets: DataFrame, *, percent: int = PERCENT, group: int = GROUP) -> DataFrame:
    """(node, comp) of the classes of resolved_sets() that share a prefix shingle with another."""
    # one row of each class; its copies' sets stay in the table
    able = sets.where("shingles is not null")
    one = written(able.select("node", "n_shingles", "shingles", "prefix").dropDuplicates(["node"]), "jaccard-classes", able.count())
    rows, entries = one.agg(F.count("*"), F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()
    tokens = one.select("node", F.col("n_shingles").alias("n"), F.explode("prefix").alias("token"))
    lists = tokens.groupBy("token").agg(F.min("node").alias("least"), F.count("*").alias("c")).where("c > 1").select(F.col("token").alias("_token"), "least")
    tokens = written(tokens.join(lists, F.col("token") == F.col("_token")).select("token", "node", "n", "least"), "jaccard-tokens", entries)
    family = tokens.groupBy("node", "n").agg(F.min("least").alias("family"))
    size = family.groupBy("family").agg(_cuts("n", group).alias("cuts")).withColumnRenamed("family", "_family")
    family = family.join(size, F.col("family") == F.col("_family")).select("node", "n", "family", "cuts", F.pmod(F.xxhash64("node"), F.col("cuts")).alias("cut"))
    name = lambda cut: F.concat("family", F.lit(":"), cut.cast("string")).cast("binary")
    up = F.floor((F.col("cut") - 1) / 2)
    family = written(family.select("node", "n", name(F.col("cut")).alias("grp"), F.when(F.col("cut") > 0, name(up)).alias("next")), "jaccard-groups", rows)

    def sent(df: DataFrame, n: int) -> DataFrame:
        return F.broadcast(df) if n <= SENT else df

    # from here on only classes with company, and what their groups need of them
    held = written(one.select("node", "shingles").join(sent(family, rows), "node").select("node", "n", "grp", "shingles"), "jaccard-held", rows)
    first = held.select("node", "shingles", "grp").groupBy("grp").applyInArrow(_own_group(percent), "a binary, b binary")
    links = written(first, "jaccard-links", rows)
    comp = components(family, links, rows)

    def against(queries: DataFrame, comp: DataFrame, many: int) -> DataFrame:
        """Links found by ``many`` queries (node, n, grp): each against all members of the group."""
        batches = queries.groupBy("grp").agg(_cuts("n", BATCH).alias("batches"))
        sized = batches.select(F.col("grp").alias("_grp"), "batches")
        dealt = queries.join(sized, F.col("grp") == F.col("_grp")).select("node", "grp", F.pmod(F.xxhash64("node"), F.col("batches")).alias("batch"))
        full = held.select("node", "shingles", F.col("grp").alias("own")).join(sent(comp, rows), "node")
        asked = full.join(sent(dealt, many), "node").select("grp", "batch", "node", "comp", "shingles")
        members = full.withColumnRenamed("own", "grp").join(sent(sized, rows), F.col("grp") == F.col("_grp"))
        members = members.select("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("batches") - 1)).alias("batch"), "node", "comp", "shingles")
        fresh = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # noqa: E731  both sides come from one table
        asked, members = fresh(asked), fresh(members)
        return asked.groupBy("grp", "batch").cogroup(members.groupBy("grp", "batch")).applyInArrow(_other_group(percent), "a binary, b binary")

    beside = family.where("next is not null").select("node", "n", F.col("next").alias("grp"))
    if not beside.isEmpty():
        links = links.union(written(against(beside, comp, rows), "jaccard-links", rows))
        comp = components(family, links, rows)

    # the rest: components of a pair differ; the lower-ranked side asks
    rank = comp.groupBy("comp").agg(F.count("*").alias("c")).select(F.col("comp").alias("_comp"), F.struct("c", "comp").alias("rank"))
    ranked = comp.join(rank, F.col("comp") == F.col("_comp")).select("node", "rank").join(family.select("node", "grp"), "node")
    placed = tokens.select("token", "node", "n").join(ranked, "node")
    matrix = placed.groupBy("token", "grp").agg(F.max("rank").alias("top"), F.min("n").alias("low"), F.max("n").alias("high"))
    matrix = matrix.select(F.col("token").alias("_token"), F.col("grp").alias("other"), "top", "low", "high")
    meets = (F.col("token") == F.col("_token")) & (F.col("top") > F.col("rank")) & _comparable("low", "high", "n", percent)
    queries = written(placed.join(matrix, meets).select("node", "n", F.col("other").alias("grp")).distinct(), "jaccard-queries", entries)
    many = queries.count()
    if not many:
        return comp
    last = written(against(queries, comp, many), "jaccard-links", rows)
    return comp if last.isEmpty() else components(family, links.union(last), rows)


def members(docs: DataFrame, *, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """A row for each distinct (doc_id, text): text_hash, copies, n_shingles and pick,
    the least (nameless, doc_id, text_hash) of its component, null where it is alone."""
    least = F.min(F.struct(F.isnull("doc_id").alias("nameless"), "doc_id", "text_hash"))
    with tidied(docs.sparkSession):
        sets = resolved_sets(docs, k=k, percent=percent)
        comp = linked_components(sets, percent=percent)
        rows = sets.select("doc_id", "text_hash", "copies", "n_shingles", "node")
        classes = rows.where("node is not null").groupBy("node").agg(least.alias("least"), F.count("*").alias("c"))
        named = classes.join(comp.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
        many = sets.where("shingles is not null").count()
        named = written(named.select("node", F.coalesce("comp", "node").alias("comp"), "least", "c"), "jaccard-named", many, keep=True)
    total = named.agg(F.sum("c")).first()[0] or 0
    picks = named.groupBy("comp").agg(F.min("least").alias("pick"), F.sum("c").alias("all")).where("all > 1").withColumnRenamed("comp", "_comp")
    picks = named.join(picks, F.col("comp") == F.col("_comp")).select(F.col("node").alias("_node"), "pick", "c")
    often = picks.where(F.col("c") > max(OFTEN, total // OFTEN)).drop("c")
    met = F.col("node") == F.col("_node")
    out = ["doc_id", "text_hash", "copies", "n_shingles", "pick"]
    if named.where(F.col("c") > max(OFTEN, total // OFTEN)).isEmpty():
        return rows.join(picks, met, "left").select(*out)
    often = F.broadcast(written(often, "jaccard-often", OFTEN))
    return rows.join(often, met).select(*out).unionByName(rows.join(often, met, "left_anti").join(picks, met, "left").select(*out))


def join(docs: DataFrame, *, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs."""
    found = members(docs, k=k, percent=percent)
    component = F.when(F.col("pick").isNull(), F.col("doc_id")).otherwise(F.col("pick.doc_id"))
    again = F.explode(F.sequence(F.lit(1).cast("long"), "copies"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), again.alias("_nth")).drop("_nth")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs less all but one of each component: the smallest doc_id's stays
    (ties: the one whose text has the least hash), one without doc_id only if no other is
    there.  Rows are told apart by doc_id and text; of rows equal in both one stays, the
    least as JSON.  Rows without words stay, all of them.  Columns of any name pass through.
    """
    columns = docs.columns
    here, i, t = unused(columns, "text_hash", "other_id", "other_hash")
    keyed = docs.withColumn(here, F.xxhash64("text"))
    rows = docs.count()
    with tidied(docs.sparkSession):
        found = written(members(docs), "jaccard-members", rows, keep=True)
    stays = (F.col("pick.text_hash") == F.col("text_hash")) & F.col("pick.doc_id").eqNullSafe(F.col("doc_id"))
    met = F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.col(here) == F.col(t))

    def sent(df: DataFrame) -> DataFrame:
        """A short list of rows goes to every executor; a longer one meets the rows in a shuffle."""
        df = written(df.select(F.col("doc_id").alias(i), F.col("text_hash").alias(t)), "jaccard-rows", rows)
        return F.broadcast(df) if df.count() <= SENT else df

    left = keyed.join(sent(found.where("pick is not null").where(~stays)), met, "left_anti")
    again = found.where("copies > 1 and n_shingles > 0").where(F.col("pick").isNull() | stays)
    whole = F.struct(*[F.col(f"`{c}`") for c in columns])
    if again.isEmpty():
        return left.select(*[f"`{c}`" for c in columns])
    again = sent(again)
    once = left.join(again, met, "left_semi").select(F.col("doc_id").alias(i), F.col(here).alias(t), whole.alias(here))
    once = once.groupBy(i, t).agg(F.min_by(here, F.to_json(here)).alias(here)).select(*[F.col(here)[c].alias(c) for c in columns])
    return left.join(again, met, "left_anti").select(*[f"`{c}`" for c in columns]).unionByName(once)
