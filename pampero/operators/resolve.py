"""Name resolution in stages: exact, subset, approximate, each only on what the one before left."""

from __future__ import annotations

import difflib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pampero.operators.stats import one_row
from pampero.session import written

#: Tokens that don't identify a club (fixed values).
NOISE = "fc cf afc ac sc cd ss ssc as us ud sv vfb vfl tsg fsv bsc sk fk nk hnk gnk bk if ik cfr rc rcd sd club clube cp sl scp kv kaa rsc krc kvc ogc osc sco pfc pfk cs csm mks ks fcs ca kf tsv acf asd ssd the de ii r psv".split()
#: Reserve and youth sides (fixed values).
RESERVE = r"(?i)(\s(B|II|III)$)|\bU-?1[5-9]\b|\bU-?2[0-3]\b|\bReserves?\b|\bYouth\b|\bAcademy\b|\bJuniors?\b|\bsub-?\d+\b"


def name_tokens(folded: Column) -> Column:
    """Tokens of a folded name without brackets and noise; repeated tokens stay."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(folded, r"\([^)]*\)", " "), r"[^a-z0-9]+", " "))
    return F.filter(F.split(plain, " "), lambda t: (t != "") & ~t.isin(NOISE))


def grams(text: Column, size: int) -> Column:
    """The different runs of ``size`` characters of a text; a shorter text is its own."""
    n = F.length(text)
    return F.array_distinct(F.when(n <= size, F.array(text)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(size)))))


def common_run(ratio: float, longest: int = 400) -> int:
    """A length of run that any two different texts of at least a sequence ratio have in common.

    With M characters matched of a + b, at most D = a + b - 2 M are left over; these part the match
    into at most D + 1 runs, of which one has M / (D + 1) characters or more. For long texts that
    tends to ratio / (2 - 2 ratio); short ones are gone through.
    """
    least = math.floor(ratio / (2 - 2 * ratio))
    for a in range(1, longest):
        for b in range(a, min(longest, math.floor(a * (2 - ratio) / ratio) + 1)):
            m = math.ceil(ratio * (a + b) / 2 - 1e-9)
            if m <= a and (a, b) != (m, m):
                least = min(least, math.ceil(m / (a + b - 2 * m + 1)))
    return max(1, least)


def _profile(texts: list[str], slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, counts of neighbouring pairs of characters and counts of characters, the latter two in hashed slots."""
    n, size = len(texts), np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    cp = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    row = np.repeat(np.arange(n), size)
    inner = row[1:] == row[:-1]
    pair = (cp[:-1] * 37 + cp[1:])[inner] % slots
    pairs = np.bincount(row[1:][inner] * slots + pair, minlength=n * slots).reshape(n, slots).astype(np.float32)
    return size, pairs, np.bincount(row * 64 + cp % 64, minlength=n * 64).reshape(n, 64).astype(np.int32)


def nearest(names: list[str], aliases: list[str], floor: float, slots: int = 256, rows: int = 128) -> list[tuple[int, int, float]]:
    """(name, alias, ratio) of the aliases with each name's best sequence ratio, if it is ``floor`` or more; all that tie.

    The ratio is difflib's, the name leading, and is taken only where it can be the best. With M of
    x + y characters matched in runs, these are at most x + y - 2 M + 1 (a left-over parts two runs),
    so a pair of the ratio shares M characters and 3 M - x - y - 1 neighbouring pairs of them. What
    two texts share is at most the product of their counts, also where slots collide; one product of
    matrices a length counts it for all pairs. The rest goes down from the most shared characters.
    """
    x, pn, cn = _profile(names, slots)
    y, pa, ca = _profile(aliases, slots)
    order = np.argsort(y, kind="stable")
    y, pa, ca = y[order], pa[order], ca[order]
    out = []
    for size in np.unique(x):
        at = np.flatnonzero(2 * np.minimum(size, y) >= floor * (size + y) - 1e-9)
        if not size or not len(at):
            continue
        near = slice(at[0], at[-1] + 1)  # lengths are sorted, so these lie together
        least = np.ceil(floor * (size + y[near]) / 2 - 1e-9).astype(np.int64)
        shared, own = (3 * least - size - y[near] - 1).astype(np.float32), np.flatnonzero(x == size)
        for part in (own[i : i + rows] for i in range(0, len(own), rows)):
            r, c = np.nonzero(pn[part] @ pa[near].T >= shared)
            most = np.concatenate([np.zeros(0, np.int64), *(np.minimum(cn[part[r[i : i + 65536]]], ca[near][c[i : i + 65536]]).sum(1) for i in range(0, len(r), 65536))])
            keep = most >= least[c]
            r, c, bound = r[keep], c[keep], 2.0 * most[keep] / (size + y[near][c[keep]])
            best, ties, now = floor, [], -1
            for k in np.lexsort((-bound, r)):
                if r[k] != now:
                    out += ties
                    best, ties, now = floor, [], r[k]
                if bound[k] < best:
                    continue
                i, j = int(part[now]), int(order[near][c[k]])
                ratio = difflib.SequenceMatcher(None, names[i], aliases[j], autojunk=False).ratio()
                if ratio >= best:
                    ties = [*(ties if ratio == best else []), (i, j, ratio)]
                    best = ratio
            out += ties
    return out


def _approximate(left: DataFrame, al: DataFrame, near: float, far: float, names: int = 2048, forms: int = 8192) -> DataFrame:
    """block, k, ak, ratio: the aliases nearest to each name, within its block or, where that isn't known, among all.

    The pairs of a block are cut into tiles of some ``names`` by ``forms``, so no task holds more than these.
    """
    inside = F.concat(F.lit("="), F.col("block").cast("string"))
    ask = left.select("block", "k", "known", F.when(F.col("known"), inside).otherwise("*").alias("g"))
    offer = al.where("ablock is not null").select(F.col("ablock").alias("block"), "ak").select(inside.alias("g"), "ak").union(al.select(F.lit("*"), "ak")).distinct()
    tiles = ask.groupBy("g").agg(F.ceil(F.count("*") / names).alias("_i")).join(offer.groupBy("g").agg(F.ceil(F.count("*") / forms).alias("_j")), "g")
    of = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    spark = left.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    x = ask.join(tiles, "g").select("g", of("k", "_i").alias("i"), every("_j").alias("j"), "block", "k", "known").repartition(parts, "g", "i", "j")
    y = offer.join(tiles, "g").select("g", every("_i").alias("i"), of("ak", "_j").alias("j"), "ak").repartition(parts, "g", "i", "j")

    def tile(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        got = nearest(a["k"].tolist(), b["ak"].tolist(), near if len(a) and a["known"].iloc[0] else far) if len(a) and len(b) else []
        i, j = [t[0] for t in got], [t[1] for t in got]
        return pd.DataFrame({"block": a["block"].iloc[i].array, "k": a["k"].iloc[i].array, "known": a["known"].iloc[i].array, "ak": b["ak"].iloc[j].array, "ratio": pd.Series([t[2] for t in got], dtype="float64")})

    kind = left.schema["block"].dataType.simpleString()
    return x.groupBy("g", "i", "j").cogroup(y.groupBy("g", "i", "j")).applyInPandas(tile, f"block {kind}, k string, known boolean, ak string, ratio double")


STAGES = ("exacto", "subconjunto", "aproximado")


@dataclass(frozen=True)
class Aliases:
    """Aliases as the stages read them: each (block, tokens) once, how often a block's aliases hold a token, each alias by its rarest one."""

    once: DataFrame
    often: DataFrame | None
    rare: DataFrame | None


def prepared(aliases: DataFrame, stages: tuple = STAGES) -> Aliases:
    """The written tables of aliases for ``resolve``, which several calls may share."""
    al = aliases.withColumn("ak", F.array_join("tokens", " ")).where("ak <> ''").groupBy(F.col("block").alias("ablock"), F.col("tokens").alias("at"), "ak").agg(F.min(F.struct("pos", "destino")).alias("m"))
    al = written(al.select("m.destino", "m.pos", "ablock", "at", "ak"), "resolve-aliases")
    if len(stages) < 2:
        return Aliases(al, None, None)
    shown = al.withColumn("t", F.explode(F.array_distinct("at")))
    often = written(shown.groupBy("ablock", "t").agg(F.count("*").alias("n")), "resolve-often")
    # an alias is one row of block and tokens, so its rarest token needs no other key than these
    rare = shown.join(often, ["ablock", "t"]).groupBy("ablock", "at").agg(F.min(F.struct("n", "t", "pos", "destino")).alias("m")).select("ablock", "at", "m.t", "m.pos", "m.destino")
    return Aliases(al, often, written(rare, "resolve-rare"))


def resolve(names: DataFrame, aliases: DataFrame | Aliases, near: float = 0.82, far: float = 0.93, stages: tuple = STAGES) -> DataFrame:
    """``id``, ``destino``, ``metodo`` of every name: (id, block, tokens) against (destino, pos, block, tokens).

    Exact token lists, then containment either way (within a block only), then the best sequence
    ratio of at least ``near`` within a block or ``far`` where the block is unknown or has no
    aliases. Each stage takes the residue of the one before; the smallest ``pos`` wins ties.
    ``stages`` are the first one, two or all of them; what these leave is ``sin_match``. Aliases
    that several calls share are ``prepared`` once.
    Names are resolved once a different (block, tokens), aliases count once a different (block,
    tokens), with their first target. Nothing that the ratios allow is lost: a list that contains
    another has also its rarest token, by which they are joined, and ratios are left out only where
    they can't be the best (``nearest``).
    Names without tokens are ``sin_nombre``, others without a hit ``sin_match``.
    """
    key = lambda c: F.array_join(c, " ")
    base = written(names.withColumn("k", key("tokens")), "resolve-names")
    aliases = aliases if isinstance(aliases, Aliases) else prepared(aliases, stages)
    al = aliases.once
    ask = base.where("k <> ''").select("block", "tokens", "k").distinct()
    blocks = al.select(F.col("ablock").alias("block")).distinct().withColumn("known", F.lit(True))
    ask = ask.join(blocks, "block", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    same = F.col("block").eqNullSafe(F.col("ablock"))
    best = lambda df, *order: df.groupBy("block", "k").agg(F.min_by(F.struct("destino", *[c for c in df.columns if c == "ratio"]), F.struct(*order)).alias("m"))
    less = lambda df, found: df.join(found.select("block", "k"), (df.block.eqNullSafe(found.block)) & (df.k == found.k), "left_anti")
    exact = best(ask.join(al, (F.col("k") == F.col("ak")) & (same | ~F.col("known"))), "pos", "destino").select("block", "k", F.col("m.destino").alias("destino"), F.lit("exacto").alias("metodo"))
    all_ = exact
    if len(stages) > 1:
        all_ = exact = written(exact, "resolve-exact")
        rest = written(less(ask, exact), "resolve-rest")
        shown, often, rare = al.withColumn("t", F.explode(F.array_distinct("at"))), aliases.often, aliases.rare
        asked = rest.where("known").withColumn("t", F.explode(F.array_distinct("tokens")))
        rarest = asked.join(often.withColumnRenamed("ablock", "block"), ["block", "t"], "left").groupBy("block", "tokens", "k").agg(F.min_by("t", F.struct(F.coalesce("n", F.lit(0)), "t")).alias("t"))
        meet = lambda a, b, inner, outer: a.alias("a").join(b.alias("b"), (F.col("block") == F.col("ablock")) & (F.col("a.t") == F.col("b.t"))).where(F.size(F.array_except(inner, outer)) == 0).select("block", "k", "destino", "pos")
        subset = best(meet(rarest, shown, "tokens", "at").union(meet(asked, rare, "at", "tokens")), "pos", "destino").select("block", "k", F.col("m.destino").alias("destino"), F.lit("subconjunto").alias("metodo"))
        if len(stages) > 2:
            subset = written(subset, "resolve-subset")
        all_ = all_.union(subset)
    if len(stages) > 2:
        scored = _approximate(less(rest, subset), al, near, far)
        scored = scored.alias("s").join(al.alias("f"), (F.col("s.ak") == F.col("f.ak")) & (same | ~F.col("known"))).select("block", "k", "ratio", "pos", "destino")
        approx = best(scored, -F.col("ratio"), "pos", "destino").select("block", "k", F.col("m.destino").alias("destino"), F.format_string("aproximado:%.2f", F.col("m.ratio")).alias("metodo"))
        all_ = all_.union(approx)
    got = base.alias("n").join(all_.alias("r"), F.col("n.block").eqNullSafe(F.col("r.block")) & (F.col("n.k") == F.col("r.k")), "left")
    return got.select("n.id", "r.destino", F.coalesce("r.metodo", F.when(F.col("n.k") == "", "sin_nombre").otherwise("sin_match")).alias("metodo"))


def one_target(matches: DataFrame, order: Column) -> DataFrame:
    """Of the sources that fell on one target the first keeps it; the others become ``duplicado:<method>``.

    The first of a target is an aggregate; sources without a target, however many, go by untouched.
    """
    there, none = matches.where("destino is not null"), matches.where("destino is null")
    first = there.groupBy("destino").agg(F.min_by("id", F.struct(order.alias("o"), F.col("id").alias("i"))).alias("_first"))
    own = F.col("id") == F.col("_first")
    kept = there.join(first, "destino").select("id", F.when(own, F.col("destino")).alias("destino"), F.when(own, F.col("metodo")).otherwise(F.concat(F.lit("duplicado:"), "metodo")).alias("metodo"))
    return kept.unionByName(none.select("id", "destino", "metodo"))


def catalogue(sources: DataFrame, aliases: DataFrame, ranks: DataFrame, tope: int | None = None, none: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(catalogue, report of what found no place): sources tied to targets one to one, in order of the target's rank.

    ``sources`` hold id, orden, block, tokens and otros_tokens: the first row of an id by ``orden``
    counts; a name that finds nothing is tried once more under the other one; of several sources on
    one target the first keeps it. ``ranks`` hold destino, puesto. Targets without a rank stand at
    the end; ``tope`` cuts by rank. The report has id and metodo, ``duplicado:`` ones included.
    """
    first = sources.groupBy("id").agg(F.min_by(F.struct("orden", "block", "tokens", "otros_tokens"), F.struct("orden", F.array_join("tokens", " "))).alias("s")).select("id", "s.*")
    first = written(first, "catalogue-first")
    aliases = prepared(aliases)
    once = written(resolve(first.select("id", "block", "tokens"), aliases), "catalogue")
    # another name of the same tokens would find no more
    again = first.where(~F.col("tokens").eqNullSafe(F.col("otros_tokens"))).join(once.where("destino is null").select("id"), "id", "left_semi")
    second = resolve(again.select("id", "block", F.col("otros_tokens").alias("tokens")), aliases).select("id", F.col("destino").alias("d2"), F.col("metodo").alias("m2"))
    both = once.join(second, "id", "left").select("id", F.coalesce("destino", "d2").alias("destino"), F.when(F.col("destino").isNull() & F.col("m2").isNotNull() & (F.col("m2") != "sin_nombre"), F.col("m2")).otherwise(F.col("metodo")).alias("metodo"))
    tied = written(one_target(both.join(first.select("id", "orden"), "id"), F.col("orden")), "catalogue")
    place = F.coalesce("puesto", F.lit(none))
    out = tied.where("destino is not null").join(ranks, "destino", "left").withColumn("lugar", place)
    if tope is not None:
        out = out.where(F.col("lugar") <= tope)
    return out.orderBy("lugar", "destino"), tied.where("destino is null").select("id", "metodo")


def match_coverage(catalogue_: DataFrame, report: DataFrame) -> DataFrame:
    """One row: cruzados, sin_cruce and cobertura over the different sources, duplicates of a target left out."""
    n = catalogue_.agg(F.count_distinct("id").alias("cruzados"))
    m = report.agg(F.count_distinct(F.when(~F.col("metodo").startswith("duplicado"), F.col("id"))).alias("sin_cruce"))
    return one_row(n, m).select("*", F.round(F.try_divide("cruzados", F.col("cruzados") + F.col("sin_cruce")), 6).alias("cobertura"))


def pick_homonym(candidates: DataFrame, by: list[str]) -> DataFrame:
    """One candidate a group by points: 3 for a token in common with the destination's club, 2 with the origin's, else 0; then score, then position.

    ``candidates`` hold candidato, equipo, destino, origen (token arrays), puntos_fuente, pos; the
    method says what decided: club_destino, club_origen, unica_sugerencia or primera_sugerencia.
    An aggregate with map-side combine; null and empty token lists share nothing.
    """
    shares = lambda a, b: F.coalesce(F.arrays_overlap(F.col(a), F.col(b)), F.lit(False))
    points = F.when(shares("equipo", "destino"), 3).when(shares("equipo", "origen"), 2).otherwise(0)
    order = F.struct(F.col("_p"), F.coalesce("puntos_fuente", F.lit(float("-inf"))), (-F.col("pos")).alias("x"))
    best = candidates.withColumn("_p", points).groupBy(*by).agg(F.max_by(F.struct("candidato", "_p"), order).alias("m"), F.count_distinct("candidato").alias("candidatos"))
    method = F.when(F.col("m._p") == 3, "club_destino").when(F.col("m._p") == 2, "club_origen").when(F.col("candidatos") == 1, "unica_sugerencia").otherwise("primera_sugerencia")
    return best.select(*by, F.col("m.candidato").alias("candidato"), method.alias("metodo"), "candidatos")
