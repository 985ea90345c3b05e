"""Template mining.

Lines with the same number of tokens never meet lines with another number, so the fixed-depth tree is mined by
(log, number of tokens) in parallel; lines shorter than the tree is deep need no state and stay out of Python. What
comes before (masking, tokens) and after (templates, ids, variables) is columns. A group holds one log's lines of one
length, in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.functions.text import WILDCARD, mask, spell_tokens, template_id, tokens, variables
from linewright.plans.lineage import ship_package


class _Branch:
    """A node of the tree: branches by token, and the clusters (their numbers) of a leaf in order of arrival."""

    __slots__ = ("branches", "clusters")

    def __init__(self) -> None:
        self.branches: dict[str, _Branch] = {}
        self.clusters: list[int] = []

    def grow(self, token: str, most: int) -> _Branch:
        """The branch for a token that has none of its own: a new one while there is room, else the wildcard's."""
        taken, wild = len(self.branches), WILDCARD in self.branches
        digit = any(c.isdigit() for c in token)
        room = taken < most if wild else taken + 1 < most
        name = token if not digit and room else WILDCARD
        return self.branches.setdefault(name, _Branch())


class FixedDepthMiner:
    """Online mining of templates of one length. Returns, for each line, the number of its cluster."""

    def __init__(self, depth: int, threshold: float, most: int):
        self.depth, self.threshold, self.most = depth, threshold, most
        self.root = _Branch()
        self.templates: list[list[str]] = []

    def _leaf(self, line: list[str], grow: bool) -> _Branch | None:
        at = self.root
        for token in line[: self.depth - 1]:
            following = at.branches.get(token) or (None if grow else at.branches.get(WILDCARD))
            if following is None:
                if not grow:
                    return None
                following = at.grow(token, self.most)
            at = following
        return at

    def add(self, line: list[str]) -> int:
        leaf = self._leaf(line, grow=False)
        best, key = None, (-1.0, -1)
        for c in leaf.clusters if leaf is not None else ():
            t = self.templates[c]
            found = (sum(a == b != WILDCARD for a, b in zip(t, line, strict=True)) / len(t), t.count(WILDCARD))
            if found > key:
                best, key = c, found
        if best is not None and key[0] >= self.threshold:
            self.templates[best] = [a if a == b else WILDCARD for a, b in zip(line, self.templates[best], strict=True)]
            return best
        self.templates.append(list(line))
        self._leaf(line, grow=True).clusters.append(len(self.templates) - 1)
        return len(self.templates) - 1


def _by_run(keys: list[str], start, columns: tuple[str, ...]):
    """A pass over rows that come sorted: rows of equal keys are a run, mined together when it ends.

    start() gives a miner with add(tokens) and templates. Runs are many and short, so they share batches: a grouped
    function would pay for a frame a run.
    """

    def ended(run: list[tuple], out: list[list]) -> None:
        miner = start()
        own = [miner.add(tokens_) for _, _, tokens_ in run]
        for (log, line, _), c in zip(run, own, strict=True):
            out.append([log, line, c, " ".join(miner.templates[c])])

    def frame(out: list[list]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["log_id", "line_id", "cluster", "template"])[list(columns)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, out = None, [], []
        for pdf in batches:
            for k, log, line, tokens_ in zip(zip(*(pdf[c] for c in keys), strict=True), pdf["log_id"], pdf["line_id"], pdf["tokens"], strict=True):
                if k != key:
                    ended(held, out)
                    key, held = k, []
                held.append((log, line, list(tokens_)))
            if out:
                yield frame(out)
                out = []
        ended(held, out)
        if out:
            yield frame(out)

    return run


def mine_templates(lines: DataFrame, patterns: tuple[str, ...] = (), depth: int = 2, threshold: float = 0.4, most: int = 3) -> DataFrame:
    """lines with tokens, template (the latest one of the line's cluster), event_id and variables.

    depth counts the level of lengths as the first: a line of at least `depth` tokens is told apart by its first
    depth - 1. A shorter line is a template of its own. An empty frame gives an empty frame.
    """
    ship_package(lines.sparkSession)
    ready = lines.withColumn("tokens", tokens(mask(F.col("text"), patterns)))
    ready = ready.withColumn("n_tokens", F.size("tokens"))
    kind = f"log_id {ready.schema['log_id'].dataType.simpleString()}, line_id long, template string"
    long_ = ready.where(F.col("n_tokens") >= depth).select("log_id", "n_tokens", "line_id", "tokens")
    dealt = long_.repartition("log_id", "n_tokens").sortWithinPartitions("log_id", "n_tokens", "line_id")
    mined = dealt.mapInPandas(_by_run(["log_id", "n_tokens"], lambda: FixedDepthMiner(depth, threshold, most), ("log_id", "line_id", "template")), kind)
    short = ready.where(F.col("n_tokens") < depth).select("log_id", "line_id", F.array_join("tokens", " ").alias("template"))
    out = ready.join(mined.unionByName(short), ["log_id", "line_id"])
    return out.withColumns({"event_id": template_id(F.col("template")), "variables": variables(F.col("template"), F.col("text"))})


def template_counts(parsed: DataFrame) -> DataFrame:
    """Occurrences of each template; equal templates of different clusters count together."""
    return parsed.groupBy(F.col("event_id").alias("EventId"), F.col("template").alias("EventTemplate")).agg(F.count(F.lit(1)).alias("Occurrences"))


def longest_common(a: list[str], b: list[str]) -> list[str]:
    """A longest common subsequence of two token lists."""
    rows = [[0] * (len(b) + 1)]
    for x in a:
        above, row = rows[-1], [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[j]))
        rows.append(row)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            out.append(a[i - 1])
            i, j = i - 1, j - 1
    return out[::-1]


def spell_template(common: list[str], template: list[str]) -> list[str]:
    """The template with a wildcard for each token before the last common one that isn't common, and one for the rest."""
    out, left = [], list(common)
    for k, token in enumerate(template):
        if not left:
            return [*out, WILDCARD] if k < len(template) and out else out
        if token == left[0]:
            out.append(left.pop(0))
        else:
            out.append(WILDCARD)
    return out


class SubsequenceMiner:
    """Online mining by a prefix tree of constant tokens, then a scan for contained templates, then common subsequences."""

    def __init__(self, share: float = 0.5):
        self.share = share
        self.templates: list[list[str]] = []
        self.tree: dict = {"next": {}, "uses": 0, "cluster": None}

    @staticmethod
    def _constant(tokens_: list[str]) -> list[str]:
        return [t for t in tokens_ if t != WILDCARD]

    def _insert(self, cluster: int) -> None:
        at = self.tree
        for t in self._constant(self.templates[cluster]):
            at = at["next"].setdefault(t, {"next": {}, "uses": 0, "cluster": None})
            at["uses"] += 1
        if at["cluster"] is None:
            at["cluster"] = cluster

    def _remove(self, cluster: int) -> None:
        at = self.tree
        for t in self._constant(self.templates[cluster]):
            below = at["next"].get(t)
            if below is None:
                continue
            if below["uses"] == 1:
                del at["next"][t]
                return
            below["uses"] -= 1
            at = below

    def _by_prefix(self, line: list[str]) -> int | None:
        at = self.tree
        for t in line:
            below = at["next"].get(t)
            if below is None:
                continue
            if below["cluster"] is None:
                at = below
            elif len(self._constant(self.templates[below["cluster"]])) >= self.share * len(line):
                return below["cluster"]
        return None

    def _by_subset(self, line: list[str]) -> int | None:
        own = {*line, WILDCARD}
        return next((c for c, t in enumerate(self.templates) if len(t) >= 0.5 * len(line) and own.issuperset(t)), None)

    def _by_subsequence(self, line: list[str]) -> tuple[int, list[str]] | None:
        own, best = set(line), None
        for c, t in enumerate(self.templates):
            if len(own.intersection(t)) >= 0.5 * len(line):
                common = longest_common(line, t)
                key = (len(common), -len(t))
                if best is None or key > best[0]:
                    best = (key, c, common)
        return best[1:] if best and best[0][0] >= self.share * len(line) else None

    def add(self, line: list[str]) -> int:
        constant = self._constant(line)
        found = self._by_prefix(constant)
        if found is None:
            found = self._by_subset(constant)
        if found is not None:
            return found
        if (near := self._by_subsequence(line)) is not None:
            c, common = near
            new = spell_template(common, self.templates[c])
            if new != self.templates[c]:
                self._remove(c)
                self.templates[c] = new
                self._insert(c)
            return c
        self.templates.append(list(line))
        self._insert(len(self.templates) - 1)
        return len(self.templates) - 1


def mine_subsequences(lines: DataFrame, patterns: tuple[str, ...] = (), share: float = 0.5) -> DataFrame:
    """log_id, line_id, cluster and template by longest common subsequences; order matters, so a log is one group."""
    ship_package(lines.sparkSession)
    ready = lines.select("log_id", "line_id", spell_tokens(mask(F.col("text"), patterns)).alias("tokens"))
    kind = f"log_id {ready.schema['log_id'].dataType.simpleString()}, line_id long, cluster long, template string"
    dealt = ready.repartition("log_id").sortWithinPartitions("log_id", "line_id")
    return dealt.mapInPandas(_by_run(["log_id"], lambda: SubsequenceMiner(share), ("log_id", "line_id", "cluster", "template")), kind)


def subsequence_counts(mined: DataFrame) -> DataFrame:
    """A row for each cluster; equal templates of different clusters stay apart."""
    one = mined.groupBy("log_id", "cluster", "template").agg(F.count(F.lit(1)).alias("Occurrences"))
    return one.withColumn("EventId", template_id(F.col("template")))


def best_template(lines: DataFrame, templates: DataFrame, threshold: float) -> DataFrame:
    """The stored template that each line is nearest to, of equal length: most similar, then most wildcards, then first.

    lines: log_id, line_id, tokens; templates: log_id, template_no, template (tokens).
    """
    from linewright.functions.text import similarity, wildcards

    pairs = lines.withColumn("n", F.size("tokens")).join(templates.withColumn("n", F.size("template")), ["log_id", "n"])
    scored = pairs.select("log_id", "line_id", "template_no", similarity(F.col("template"), F.col("tokens")).alias("sim"), wildcards(F.col("template")).alias("wild"))
    best = scored.groupBy("log_id", "line_id").agg(F.max(F.struct("sim", "wild", (-F.col("template_no")).alias("first"))).alias("b"))
    return best.select("log_id", "line_id", (-F.col("b.first")).alias("template_no"), F.col("b.sim").alias("sim")).where(F.col("sim") >= threshold)
