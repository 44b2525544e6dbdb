"""Problem 8: mixing sources to target shares of the tokens.

Documents are counted in tokens and summed by membership pattern (the set of
target sources that they belong to). A min-cost flow routes each pattern's
token capacity to the sources' quotas; the k-th use of the same tokens costs
more than the one before. The routed amounts are then filled with documents in
the order of a seeded hash.
"""

import os
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from permway.sources.shared import shared_dir

#: Documents that share a bucket of hashes, on average; a window orders one bucket.
BUCKET_DOCS = 20_000
#: Routed pieces that may be broadcast; beyond, they are joined by a shuffle.
BROADCAST_PIECES = 50_000


@lru_cache(maxsize=4)
def _encoder(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_vocabulary() -> str:
    """The place of the public byte-level vocabulary that is used unless another is named."""
    return os.environ.get("PERMWAY_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def token_count(path: str):
    """A column function that counts the tokens of a text with the vocabulary at `path`."""

    @F.pandas_udf(T.LongType())
    def count(text: pd.Series) -> pd.Series:
        encode = _encoder(path).encode_ordinary
        return pd.Series([None if t is None else len(encode(t)) for t in text], dtype="Int64")

    return count


@dataclass(frozen=True)
class Target:
    source: str
    share: float
    max_repeats: int


class Network:
    """Maximal flows by Dinic's method on arcs that can be added while it stands: [to, capacity left, index of the arc back]."""

    def __init__(self, nodes: int):
        self.arcs: list[list[list[int]]] = [[] for _ in range(nodes)]

    def add(self, u: int, v: int, capacity: int) -> list[int]:
        self.arcs[u].append([v, capacity, len(self.arcs[v])])
        self.arcs[v].append([u, 0, len(self.arcs[u]) - 1])
        return self.arcs[u][-1]

    def levels(self, s: int) -> list[int]:
        """The distance of each node from `s` along arcs with capacity left, -1 if there is no way."""
        level = [-1] * len(self.arcs)
        level[s], wave = 0, [s]
        while wave:
            ahead = []
            for u in wave:
                for v, left, _ in self.arcs[u]:
                    if left > 0 and level[v] < 0:
                        level[v] = level[u] + 1
                        ahead.append(v)
            wave = ahead
        return level

    def push(self, s: int, t: int) -> int:
        """Augment until no way is left; the flow that was added."""
        arcs, total = self.arcs, 0
        while (level := self.levels(s))[t] >= 0:
            tried = [0] * len(arcs)
            path: list[tuple[int, list[int]]] = []
            u = s
            while True:
                if u == t:
                    amount = min(arc[1] for _, arc in path)
                    total += amount
                    for _, arc in path:
                        arc[1] -= amount
                        arcs[arc[0]][arc[2]][1] += amount
                    full = next(i for i, (_, arc) in enumerate(path) if arc[1] == 0)
                    u = path[full][0]
                    del path[full:]
                while tried[u] < len(arcs[u]):
                    arc = arcs[u][tried[u]]
                    if arc[1] > 0 and level[arc[0]] == level[u] + 1:
                        break
                    tried[u] += 1
                else:
                    if u == s:
                        break
                    u, _ = path.pop()
                    tried[u] += 1
                    continue
                path.append((u, arc))
                u = arc[0]
        return total


Patterns = list[tuple[tuple[str, ...], int]]


def _network(patterns: Patterns, targets: list[Target], total: int) -> tuple[Network, list[list[list]], dict, int, dict[str, int]]:
    """The network without the arcs of supply: those per layer, the arcs to sources, the sink, and the nodes of the sources."""
    sources = {x.source: x for x in targets}
    own = [(p, size, max((sources[s].max_repeats for s in p if s in sources), default=0)) for p, size in patterns]
    layers = [(p, k, size) for p, size, depth in own for k in range(1, depth + 1)]
    t = 1 + len(layers) + len(targets)
    net = Network(t + 1)
    at = {x.source: 1 + len(layers) + i for i, x in enumerate(targets)}
    supply: list[list[list]] = [[] for _ in range(max((d for _, _, d in own), default=0))]
    uses = {}
    for i, (p, k, size) in enumerate(layers):
        supply[k - 1].append([1 + i, size])
        for source in p:
            if source in sources and k <= sources[source].max_repeats:
                uses[p, source, k] = (net.add(1 + i, at[source], size), size)
    for x in targets:
        net.add(at[x.source], t, round(x.share * total))
    return net, supply, uses, t, at


def route(patterns: Patterns, targets: list[Target], total: int) -> dict[tuple[tuple[str, ...], str, int], int]:
    """Tokens routed from (pattern, layer of use) to source, by (pattern, source, layer): a flow of least cost.

    A pattern's tokens can be used once in each layer 1, 2, ...; a source takes
    them up to layer `max_repeats`. A use in layer k costs more than one in the
    layer before, so costs are convex and nothing is repeated while unused
    tokens can fill a quota. Only the arcs of supply have costs, hence ways of
    least cost are those that start in the lowest layer: opening the layers
    one after the other and filling up each time gives the flow of least cost.
    """
    net, supply, uses, t, _ = _network(patterns, targets, total)
    for layer in supply:
        for node, size in layer:
            net.add(0, node, size)
        net.push(0, t)
    return {key: size - arc[1] for key, (arc, size) in uses.items() if size > arc[1]}


def largest_total(patterns: Patterns, targets: list[Target]) -> int:
    """The largest total at which every source that has documents can fill its quota, but for the rounding of quotas to whole tokens.

    For every set of sources the quotas must not exceed what its documents can
    give. Starting above, a flow that leaves a quota open names a set that is
    short, by the cut; the total falls to what that set allows, and so on. Each
    step is exact and finds another set, so a few flows are enough.
    """
    able = {x.source for x in targets for p, size in patterns if x.source in p and size and x.max_repeats > 0 and x.share > 0}
    live = [x for x in targets if x.source in able]
    if not live:
        return 0
    repeats = {x.source: x.max_repeats for x in live}
    gives = lambda some: sum(size * max((repeats[s] for s in p if s in some), default=0) for p, size in patterns)
    share = lambda some: sum(x.share for x in live if x.source in some)
    total = int(gives(able) / share(able)) + 1
    while total > 0:
        net, supply, _, t, at = _network(patterns, live, total)
        for layer in supply:
            for node, size in layer:
                net.add(0, node, size)
        if net.push(0, t) >= sum(round(x.share * total) for x in live):
            return total
        reached = net.levels(0)
        short = {s for s, node in at.items() if reached[node] < 0}
        total = min(total - 1, int(gives(short) / share(short)) + 1)
    return 0


def _amounts(flow: dict, patterns: list, targets: list[Target]) -> list[tuple[str, str, int, int]]:
    """(pattern, source, first token, last token) of each routed piece on a pattern's line of tokens, by layer."""
    rows, at = [], {}
    for (p, source, k), amount in sorted(flow.items()):
        start = at.get((p, k), 0)
        rows.append(("\u0001".join(p), source, start, start + amount))
        at[p, k] = start + amount
    return rows


def counted(documents: DataFrame, targets: DataFrame, vocabulary: str, seed: int) -> DataFrame:
    """`doc_id, pattern, n_tokens, h`: the documents that have a target, with their token count and seeded hash.

    `source` is a string or an array of strings. Documents with a null text or
    without a target are left out; an empty text counts no tokens.
    """
    names = F.broadcast(targets.where("source IS NOT NULL").agg(F.array_sort(F.collect_set("source")).alias("__names")))
    source = F.col("source") if isinstance(documents.schema["source"].dataType, T.ArrayType) else F.array("source")
    docs = documents.select("doc_id", "text", source.alias("own")).where("text IS NOT NULL").crossJoin(names)
    docs = docs.select("doc_id", "text", F.array_sort(F.array_intersect(F.col("own"), F.col("__names"))).alias("member")).where(F.size("member") > 0)
    tokens = token_count(vocabulary)(F.col("text"))
    return docs.select("doc_id", F.array_join("member", "\u0001").alias("pattern"), tokens.alias("n_tokens"), F.xxhash64("doc_id", F.lit(seed)).alias("h"))


@dataclass
class Mixture:
    total: int
    #: `doc_id, source, n_tokens, uses`
    selection: DataFrame
    #: `source, target_share, max_repeats, n_docs, tokens_available, tokens_used, share, most_uses`
    shares: DataFrame


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, vocabulary: str | None = None, seed: int = 7, max_patterns: int = 10_000) -> Mixture:
    """Choose documents so that each source has its target share of the tokens.

    Without `total_tokens` the total is the largest at which every source that
    has any documents reaches its share without using one more than
    `max_repeats` times. A source without documents stays at 0 and the others
    keep their proportions. The targets and the sums by pattern come to the
    driver, which raises an error for more than `max_patterns` of either, as
    the flow is found there; documents never do.
    Documents fill each routed amount in the order of their seeded hash, so the
    reached amount differs from it by at most one document per routed piece.
    """
    spark = documents.sparkSession
    wanted = [Target(r.source, float(r.target_share or 0), int(r.max_repeats or 0)) for r in targets.where("source IS NOT NULL").orderBy("source").limit(max_patterns + 1).collect()]
    if len(wanted) > max_patterns:
        raise ValueError(f"more than {max_patterns} targets")
    path = shared_dir(spark, "mixture")
    counted(documents, targets, vocabulary or default_vocabulary(), seed).write.parquet(path)
    docs = spark.read.parquet(path)
    sums = docs.groupBy("pattern").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs"))
    rows = sums.orderBy("pattern").limit(max_patterns + 1).collect()
    if len(rows) > max_patterns:
        raise ValueError(f"documents have more than {max_patterns} combinations of sources")
    patterns = [(tuple(r.pattern.split("\u0001")), int(r.tokens)) for r in rows]
    total = largest_total(patterns, wanted) if total_tokens is None else total_tokens
    pieces = _amounts(route(patterns, wanted, total), patterns, wanted)

    # Each document's place on its pattern's line of tokens: the tokens before its bucket of
    # hashes (a small sum per pattern and bucket) and before it within the bucket (a window over a bucket).
    from pyspark.sql import Window

    buckets = max(1, sum(r.n_docs for r in rows) // BUCKET_DOCS)
    docs = docs.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    line = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = docs.groupBy("pattern", "bucket").agg(F.sum("n_tokens").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(line), F.lit(0))).drop("n")
    inside = Window.partitionBy("pattern", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.withColumn("ahead", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(before, ["pattern", "bucket"])
    placed = placed.select("doc_id", "pattern", "n_tokens", (F.col("start") + F.col("ahead") + F.col("n_tokens") / 2).alias("at"))
    schema = "pattern string, source string, first bigint, last bigint"
    piece = spark.createDataFrame(pieces, schema)
    piece = F.broadcast(piece) if len(pieces) <= BROADCAST_PIECES else piece.hint("merge")
    chosen = placed.join(piece, "pattern").where("at >= first AND at < last")
    selection = chosen.groupBy("doc_id", "source").agg(F.max("n_tokens").alias("n_tokens"), F.count("*").alias("uses"))

    own = sums.select(F.explode(F.split("pattern", "\u0001")).alias("source"), "tokens", "n_docs").groupBy("source").agg(F.sum("tokens").alias("tokens_available"), F.sum("n_docs").alias("n_docs"))
    used = selection.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens_used"), F.max("uses").alias("most_uses"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    all_used = used.agg(F.sum("tokens_used").alias("all_used"))
    shares = targets.where("source IS NOT NULL").select("source", "target_share", "max_repeats").join(own, "source", "left").join(used, "source", "left").crossJoin(F.broadcast(all_used))
    share = F.coalesce(F.col("tokens_used") / F.col("all_used"), F.lit(0.0))
    shares = shares.select("source", "target_share", "max_repeats", zero("n_docs"), zero("tokens_available"), zero("tokens_used"), share.alias("share"), zero("most_uses"))
    return Mixture(total, selection, shares)
