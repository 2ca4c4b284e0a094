"""References, intervals, nearest earlier rows, reconciliation and closure as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.shared import written


def unreferenced(definitions: DataFrame, uses: DataFrame, on: str) -> DataFrame:
    """Definitions that nothing uses."""
    return definitions.join(uses.select(on), on, "left_anti")


def only_from(definitions: DataFrame, uses: DataFrame, on: str, test) -> DataFrame:
    """Definitions with uses that all satisfy `test`."""
    judged = uses.groupBy(on).agg(F.bool_and(test).alias("_all")).where("_all").select(on)
    return definitions.join(judged, on, "left_semi")


def latest_before(rows: DataFrame, key: str, order: list[str], anchor, columns: dict[str, str], within: int | None = None) -> DataFrame:
    """`rows` with the columns of the nearest earlier row of the key that satisfies `anchor`, at most `within` rows back.

    A running aggregate over one sort, instead of an interval join."""
    frame = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding if within is None else -within, -1)
    return rows.withColumns({new: F.last(F.when(anchor, F.col(old)), ignorenulls=True).over(frame) for new, old in columns.items()})


def interval_owner(points: DataFrame, spans: DataFrame, key: str, at: str, width: int) -> DataFrame:
    """(points…, owner): the narrowest span (key, start, end, owner) of the key with start <= at < end; NULL if none.

    Spans are cut into buckets of `width`, so the range condition becomes an equi-join and a residual."""
    cut = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width)))).where(F.col("end") > F.col("start"))
    marked = points.withColumn("_b", F.floor(F.col(at) / width))
    hit = (F.col(f"p.{key}") == F.col(f"s.{key}")) & (F.col("p._b") == F.col("s._b")) & (F.col("s.start") <= F.col(f"p.{at}")) & (F.col(f"p.{at}") < F.col("s.end"))
    joined = marked.alias("p").join(cut.alias("s"), hit, "left")
    least = F.min(F.when(F.col("s.owner").isNotNull(), F.struct((F.col("s.end") - F.col("s.start")).alias("w"), F.col("s.owner").alias("owner"))))
    return joined.groupBy(*(F.col(f"p.{c}") for c in points.columns)).agg(least["owner"].alias("owner"))


def parity(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(key, left_value, right_value, status): EQUAL, DIFF or GAP, NULL equal to NULL."""
    a, b = left.select(key, F.col(value).alias("left_value"), F.lit(True).alias("_a")), right.select(key, F.col(value).alias("right_value"), F.lit(True).alias("_b"))
    status = F.when(F.col("_a").isNull() | F.col("_b").isNull(), "GAP").when(F.col("left_value").eqNullSafe(F.col("right_value")), "EQUAL").otherwise("DIFF")
    return a.join(b, key, "full_outer").select(key, "left_value", "right_value", status.alias("status"))


def reconciled(facts: DataFrame, dimension: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of the facts for every row of the dimension, zero where there is none."""
    counted = facts.groupBy(*keys).agg(F.count("*").alias("n"))
    return dimension.join(counted, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def ratchet(now: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """(key, verdict): what is new against a baseline, and what is gone from it; both fail a two-way gate."""
    return now.join(baseline, key, "left_anti").select(key, F.lit("new").alias("verdict")).unionByName(baseline.join(now, key, "left_anti").select(key, F.lit("gone").alias("verdict")))


#: Steps of a round where the edges are few, and the most rows that are few.
HOPS, FEW = 4, 1 << 16


def _small(rows: DataFrame, n: int) -> DataFrame:
    """The right side of a semi or anti join, sent to all executors only if its n rows are few."""
    return F.broadcast(rows) if n <= FEW else rows.hint("merge")


def _sizes(front: DataFrame) -> tuple[int, int]:
    """How many nodes, and how many of them are NULL."""
    return tuple(front.agg(F.count("*"), F.count_if(F.col("node").isNull())).first())


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node) reached from `roots` (node) over `edges` (u, v), however long the way.

    Each round steps from the nodes that the last one found, and is written; it ends when none is new, so cycles and many ways to
    a node cost nothing more, and a lost executor costs one round. The edges stay where they are: a round looks its nodes up in
    them, so what the driver sends is the nodes found, and those of a large round are joined by sorting. Only few edges, where a
    round's steps can't be many rows either, are stepped over HOPS times a round."""
    edges = written(edges.select("u", "v").distinct(), "reach-edges")
    hops = HOPS if edges.count() <= FEW else 1
    front = written(roots.select("node").distinct(), "reached")
    known, parts, (n, nulls) = front, 1, _sizes(front)
    total = n
    while n:
        step, near, ahead = front, n, None
        for _ in range(hops):
            step = edges.join(_small(step, near), F.col("u") == F.col("node"), "left_semi").select(F.col("v").alias("node")).distinct()
            ahead, near = step if ahead is None else ahead.union(step).distinct(), 0
        if nulls:  # which no join would find among the known
            ahead = ahead.where("node IS NOT NULL")
        front = written(ahead.join(_small(known, total), "node", "left_anti"), "reached")
        known, parts, (n, more) = known.union(front), parts + 1, _sizes(front)
        total, nulls = total + n, nulls + more
        if parts > 8:  # so that a long way doesn't make a long plan
            known, parts = written(known, "reached"), 1
    return known


def used(definitions: DataFrame, uses: DataFrame) -> DataFrame:
    """Definitions (path, name, start, end, …) named by a use (path, name, at) that isn't inside them.

    A name in its own definition, its recursion included, doesn't keep it alive."""
    sites = uses.select(F.col("path").alias("_site"), F.col("name").alias("_name"), F.col("at").alias("_at"))
    own = (F.col("_site") == F.col("path")) & (F.col("start") <= F.col("_at")) & (F.col("_at") < F.col("end"))
    return definitions.join(sites, (F.col("name") == F.col("_name")) & ~own, "left_semi")


def soft_reference(names: DataFrame, words: DataFrame, buckets: list[str]) -> DataFrame:
    """`names` (name, …) with `found_in`: the first of the buckets whose `words` (bucket, word) have the name; NULL if none."""
    rank = F.array_position(F.array(*map(F.lit, buckets)), F.col("bucket"))
    first = words.where(rank > 0).groupBy(F.col("word").alias("name")).agg(F.min_by("bucket", rank).alias("found_in"))
    return names.join(first, "name", "left")


def islands(modules: DataFrame, uses: DataFrame) -> DataFrame:
    """Modules (path, stem) whose stem no other module's uses (path, name) name; those of packages and entries never are."""
    others = uses.select(F.col("path").alias("_site"), F.col("name").alias("_name"))
    free = modules.where(~F.col("stem").isin("__init__", "__main__"))
    return free.join(others, (F.col("stem") == F.col("_name")) & (F.col("path") != F.col("_site")), "left_anti")


def enclosing(nodes: DataFrame, kind: str) -> DataFrame:
    """(path, id, ancestor): the nearest node of a kind around each node of (path, id, kind, start, end); NULL if none.

    Spans of a tree nest, so the nearest is the shortest that holds it."""
    outer = nodes.where(F.col("kind") == kind).select("path", F.col("id").alias("ancestor"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    held = (F.col("_s") <= F.col("start")) & (F.col("end") <= F.col("_e")) & (F.col("ancestor") != F.col("id"))
    joined = nodes.alias("n").join(outer.alias("o"), (F.col("n.path") == F.col("o.path")) & held, "left")
    return joined.groupBy(F.col("n.path").alias("path"), F.col("n.id").alias("id")).agg(F.min_by("ancestor", F.col("_e") - F.col("_s")).alias("ancestor"))


def census(declared: DataFrame, visited: DataFrame, judged: DataFrame, kinds: DataFrame) -> DataFrame:
    """(kind, declared, visited, judged, visited_share, judged_share) for every kind, zeros where nothing is declared.

    Sites are (path, kind, owner, name); a share of nothing is NULL."""
    key = ["path", "kind", "owner", "name"]
    seen, told = visited.select(*key).distinct().withColumn("_v", F.lit(1)), judged.select(*key).distinct().withColumn("_j", F.lit(1))
    sites = declared.select(*key).distinct().join(seen, key, "left").join(told, key, "left")
    counted = sites.groupBy("kind").agg(F.count("*").alias("d"), F.count("_v").alias("v"), F.count("_j").alias("j"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    share = lambda c: F.round(F.try_divide(F.col(c), F.col("d")), 6)
    joined = kinds.select("kind").join(counted, "kind", "left")
    return joined.select("kind", zero("d").alias("declared"), zero("v").alias("visited"), zero("j").alias("judged"), share("v").alias("visited_share"), share("j").alias("judged_share"))


def unbounded_references(references: DataFrame, bounded: DataFrame) -> DataFrame:
    """References (path, func, state) to state that isn't bounded (path, state) in their file."""
    return references.join(bounded.select("path", "state").distinct(), ["path", "state"], "left_anti")


def modelled(surface: DataFrame, models: DataFrame) -> DataFrame:
    """(path, model): in-file if a model's path is the surface's own, elsewhere if a model's words name its stem, else unmodelled.

    Both are equi-joins, the second on the words of models, instead of a search of every text for every stem."""
    own = models.select(F.col("path")).distinct().withColumn("_own", F.lit(True))
    words = models.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), 0)).alias("stem")).distinct().withColumn("_named", F.lit(True))
    joined = surface.select("path", "stem").distinct().join(own, "path", "left").join(words, "stem", "left")
    return joined.select("path", F.when(F.col("_own"), "in-file").when(F.col("_named"), "elsewhere").otherwise("unmodelled").alias("model"))


def confirmed(races: DataFrame, surface: DataFrame) -> DataFrame:
    """Races (id, file, …) in a file of the surface (file): one path ends in the other, in either direction.

    All endings of both are keys, so that this is two equi-joins and no comparison of every pair."""
    def endings(rows: DataFrame, keep: list[str]) -> DataFrame:
        n = F.length("file")
        return rows.select(*keep, F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(F.col("file"), i, n))).alias("_end"))

    mine, theirs = races.select("id", "file").distinct(), surface.select("file").distinct()
    longer = endings(mine, ["id"]).join(theirs.select(F.col("file").alias("_end")), "_end", "left_semi").select("id")
    shorter = mine.join(endings(theirs, []).select(F.col("_end").alias("file")).distinct(), "file", "left_semi").select("id")
    return races.join(longer.union(shorter).distinct(), "id", "left_semi")


def evidenced(facets: DataFrame, evidence: DataFrame) -> DataFrame:
    """`facets` (func, facet, name, place) with `shown`: whether a test gives the facet's name or, unnamed, its place.

    Two equi-joins, for a join on either would compare all pairs."""
    by_name = evidence.where("name IS NOT NULL").select("func", "facet", "name").distinct().withColumn("_n", F.lit(True))
    by_place = evidence.where("name IS NULL AND place IS NOT NULL").select("func", "facet", "place").distinct().withColumn("_p", F.lit(True))
    joined = facets.join(by_name, ["func", "facet", "name"], "left").join(by_place, ["func", "facet", "place"], "left")
    return joined.select(*facets.columns, (F.coalesce("_n", F.lit(False)) | F.coalesce("_p", F.lit(False))).alias("shown"))


def allowed(findings: DataFrame, notes: DataFrame, reach: int = 3) -> DataFrame:
    """`findings` (path, clause, line, …) with `reason`: that of the nearest note (path, clause, line, reason) of the clause on
    the line or at most `reach` lines above; a note without a reason allows nothing.

    Lines are cut into buckets one longer than the reach, so a note is in two at most; in each, one sort and a running last note.
    Nothing is put on every line that a note reaches, and no side of a join can be taken for one small enough to broadcast."""
    width, key = reach + 1, ["path", "clause", "line"]
    given = notes.where("trim(reason) <> '' AND path IS NOT NULL AND clause IS NOT NULL AND line IS NOT NULL").groupBy(*key).agg(F.min("reason").alias("reason"))
    cuts = F.array_distinct(F.array(F.expr(f"line div {width}"), F.expr(f"(line + {reach}) div {width}")))
    given = given.select(*key, F.explode(cuts).alias("_b"), F.struct("line", "reason").alias("_note"))
    found = findings.select(*key, F.struct(*key, *(c for c in findings.columns if c not in key)).alias("_found"))
    # Findings without a line have no note; their own hashes spread them.
    found = found.withColumn("_b", F.coalesce(F.expr(f"line div {width}"), F.xxhash64("_found")))
    so_far = Window.partitionBy("path", "clause", "_b").orderBy("line", F.col("_found").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = given.unionByName(found, allowMissingColumns=True).withColumn("_last", F.last("_note", ignorenulls=True).over(so_far))
    return both.where("_found IS NOT NULL").select("_found.*", F.when(F.col("line") - F.col("_last.line") <= reach, F.col("_last.reason")).alias("reason"))


def siblings_called(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """(path, func, callee): calls (path, func, callee) of other functions (path, func) of the same module, once each."""
    local = functions.select("path", F.col("func").alias("callee"))
    return calls.where("func <> callee").select("path", "func", "callee").distinct().join(local, ["path", "callee"], "left_semi").select("path", "func", "callee")


def code_sets(left: DataFrame, right: DataFrame, measured: str) -> DataFrame:
    """(code, status): shared, missing on a side, or in both but unmeasured in one, of two panels (code, value)."""
    a = left.select("code", F.col(measured).isNotNull().alias("_a"))
    b = right.select("code", F.col(measured).isNotNull().alias("_b"))
    status = F.when(F.col("_a").isNull(), "missing left").when(F.col("_b").isNull(), "missing right").when(F.col("_a") & F.col("_b"), "shared").otherwise("unmeasured")
    return a.join(b, "code", "full_outer").select("code", status.alias("status"))
