"""Entities of two sources without a common key: sorted neighbourhood, weighted similarities, one-to-one assignment."""

from __future__ import annotations

import difflib
import json
import math
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

from pampero.llm.components import components
from pampero.session import forget, written


def mapped(f: Callable, kind: str) -> Callable[[Column], Column]:
    """A function of one value as a column function: Arrow batches, each different value once."""

    @pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        known = {v: f(v) for v in s.unique()}
        return s.map(known)

    return lambda c: run(F.col(c) if isinstance(c, str) else c)


# --- neighbourhood ---------------------------------------------------------------------------

def neighbours(records: DataFrame, keys: str, codes: list[str], possible: Callable[[dict, dict], np.ndarray] | None = None, window: int = 12, block: int = 4_000) -> DataFrame:
    """The different pairs ``a``, ``b`` of records of both sides that stand within ``window`` places in any of several sort orders.

    ``records`` holds rid (bigint), side ('a' or 'b'), numeric ``codes`` and an array ``keys`` of
    composite sort keys, one order each; an empty key takes no part. All orders are sorted at once
    by range partitions; only ids and codes travel. A row's position is its rank in its partition
    plus the rows of the partitions before. Positions are cut into blocks of ``block`` rows, each
    with the last ``window`` rows of the block before, so a block is bounded whatever the keys: a
    key that a third of all rows share is spread over many blocks. Equal keys are ordered by rid,
    so runs agree. ``possible`` gets the codes of many pairs at once (name -> array) and says which
    of them can be a match at all.
    """
    spark = records.sparkSession
    rows = records.select("rid", (F.col("side") == "a").alias("left"), *codes, F.posexplode(keys).alias("pass", "key")).where("key is not null and key <> ''")
    # every record stands once an order: parts as much smaller keep a task's sort small
    parts = 4 * max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(parts, "pass", "key", "rid").sortWithinPartitions("pass", "key", "rid")
    ident = F.monotonically_increasing_id()
    placed = written(ordered.withColumn("id", ident).select("rid", "left", *codes, F.col("pass").cast("smallint").alias("pass"), F.shiftright("id", 33).cast("int").alias("part"), F.col("id").bitwiseAND((1 << 33) - 1).alias("at")), "sn-sorted")
    # as many rows as there are partitions
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    at = placed.join(before, "part").withColumn("pos", F.col("before") + F.col("at"))
    own = F.floor(F.col("pos") / block)
    both = F.when(F.pmod("pos", F.lit(block)) >= block - window, F.array(own, own + 1)).otherwise(F.array(own))
    cut = at.select("rid", "left", *codes, "pass", "pos", F.explode(both).alias("block"))

    def scan(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos", kind="stable")
        rid, left, order = (frame[c].to_numpy() for c in ("rid", "left", "pass"))
        values = {c: frame[c].to_numpy(dtype=float) for c in codes}
        found = [np.zeros((0, 2), np.int64)]
        for step in range(1, window + 1):
            i = np.flatnonzero((left[step:] != left[:-step]) & (order[step:] == order[:-step]))
            first = left[i]
            x, y = np.where(first, i, i + step), np.where(first, i + step, i)
            if possible is not None and len(x):
                keep = possible({c: v[x] for c, v in values.items()}, {c: v[y] for c, v in values.items()})
                x, y = x[keep], y[keep]
            found.append(np.stack([rid[x], rid[y]], 1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return cut.repartition(parts, "block").groupBy("block").applyInPandas(scan, "a bigint, b bigint").distinct()


# --- assignment ------------------------------------------------------------------------------

def local_auction(a: list, b: list, gain: list, step: float) -> list[tuple]:
    """(a, b, gain) one to one, within ``step`` a pair of the greatest total: bids and prices over the links of a task."""
    links: dict = {}
    for x, y, g in sorted(zip(a, b, gain)):
        links.setdefault(x, []).append((y, g))
    price: dict = {}
    holder: dict = {}
    waiting = list(reversed(links))
    while waiting:
        x = waiting.pop()
        best, second, y, worth = 0.0, 0.0, None, 0.0
        for z, g in links[x]:
            net = g - price.get(z, 0.0)
            if net > best:
                best, second, y, worth = net, best, z, g
            elif net > second:
                second = net
        if y is None:
            continue  # prices only rise: it stays alone
        price[y] = worth - second + step
        if y in holder:
            waiting.append(holder[y])
        holder[y] = x
    return [(x, y, next(g for z, g in links[x] if z == y)) for y, x in holder.items()]


def auction(pairs: DataFrame, step: float) -> DataFrame:
    """The same bids in rounds over tables: all unassigned bid at once, each b goes to its highest bid.

    Prices only rise, by ``step`` at least, so it ends. Nothing is collected.
    """
    spark = pairs.sparkSession
    pairs = written(pairs.select("a", "b", "confianza"), "au-pairs")
    held = spark.createDataFrame([], pairs.select("a", "b", F.col("confianza").alias("price")).schema)
    active = pairs.select("a").distinct()
    while True:
        live = pairs.join(active, "a").join(held.select("b", "price"), "b", "left").withColumn("net", F.col("confianza") - F.coalesce("price", F.lit(0.0))).where("net > 0")
        top = live.groupBy("a").agg(F.max_by(F.struct("b", "confianza", "net"), F.struct("net", "b")).alias("t"))
        second = live.join(top, "a").where("b <> t.b").groupBy("a").agg(F.max("net").alias("second"))
        bids = top.join(second, "a", "left").select("a", F.col("t.b").alias("b"), (F.col("t.confianza") - F.coalesce("second", F.lit(0.0)) + step).alias("price"))
        won = written(bids.groupBy("b").agg(F.max_by("a", F.struct("price", "a")).alias("a"), F.max("price").alias("price")).select("a", "b", "price"), "au-won")
        if won.isEmpty():
            return held.join(pairs, ["a", "b"]).select("a", "b", "confianza")
        kept, was = held.join(won, "b", "left_anti"), (held, active)
        held = written(kept.unionByName(won), "au-held")
        # who bid or was freed and holds nothing tries again; who found nothing above its price never will
        active = written(live.select("a").distinct().join(held, "a", "left_anti").unionByName(won.join(pairs, "b").select(pairs.a)).distinct().join(held, "a", "left_anti"), "au-active")
        forget(won, *was)


def assign(pairs: DataFrame, step: float = 0.001, links: int = 20_000) -> DataFrame:
    """One-to-one ``a``, ``b``, ``confianza`` of greatest total confidence, within ``step`` a pair of it.

    An auction at every size: components of the pairs are independent, so tasks hold the auctions
    of whole components, many at a time, as far as these have up to ``links`` pairs; a larger
    component's auction runs in rounds over tables. Repeated pairs count by their greatest
    confidence; no pairs, no rows.
    """
    pairs = written(pairs.groupBy("a", "b").agg(F.max("confianza").alias("confianza")), "as-pairs")
    kind = {c: pairs.schema[c].dataType.simpleString() for c in ("a", "b")}
    cc = components(pairs.select(F.concat(F.lit("a"), "a").alias("x"), F.concat(F.lit("b"), "b").alias("y")), "x", "y")
    cc = cc.where(F.col("node").startswith("a")).select(F.expr(f"cast(substring(node, 2) as {kind['a']})").alias("a"), "component")
    tied = written(pairs.join(cc, "a"), "as-tied")
    size = written(tied.groupBy("component").agg(F.count("*").alias("n")), "as-sizes")
    whole = size.agg(F.sum("n")).first()[0] or 0
    tasks = max(1, math.ceil(whole / max(1, links)))

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(local_auction(frame["a"].tolist(), frame["b"].tolist(), frame["confianza"].tolist(), step), columns=["a", "b", "confianza"])

    small = tied.join(size.where(F.col("n") <= links).select("component"), "component", "left_semi")
    task = F.pmod(F.xxhash64("component"), F.lit(4 * tasks))
    out = small.withColumn("_t", task).groupBy("_t").applyInPandas(solve, f"a {kind['a']}, b {kind['b']}, confianza double")
    large = tied.join(size.where(F.col("n") > links).select("component"), "component", "left_semi")
    return out.union(auction(large, step)) if not large.isEmpty() else out


# --- similarities ----------------------------------------------------------------------------

@lru_cache(50_000)
def token_similarity(x: str, y: str) -> float:
    """1 for equal tokens; initials and abbreviations by their prefix; else the share of characters in common order."""
    if x == y:
        return 1.0
    if len(x) > len(y):
        x, y = y, x
    if y.startswith(x):
        return 0.85 if len(x) == 1 else 0.95 if len(x) >= 3 else 0.8
    if len(x) < 3 or abs(len(x) - len(y)) > 4:
        return 0.0
    # no more characters can be in common than those of one that the other has at all
    if 2 * sum(map(y.__contains__, x)) < 0.7 * (len(x) + len(y)):
        return 0.0
    match = difflib.SequenceMatcher(None, x, y, autojunk=False)
    if match.real_quick_ratio() < 0.7 or match.quick_ratio() < 0.7:
        return 0.0
    ratio = match.ratio()
    # two neighbouring letters exchanged cost one slip, not two
    slips = sum(a != b for a, b in zip(x, y))
    if len(x) == len(y) and slips == 2 and sorted(x) == sorted(y):
        ratio = max(ratio, 0.95)
    return ratio if ratio >= 0.7 else 0.0


def soft_overlap(x: list[tuple[str, float]], y: list[tuple[str, float]]) -> float:
    """Weighted share of both names' tokens that find a like token in the other, each used once."""
    total = sum(w for _, w in x) + sum(w for _, w in y)
    if not total:
        return 0.0
    links = [(s * min(wa, wb), s, i, j) for i, (a, wa) in enumerate(x) for j, (b, wb) in enumerate(y) if (s := token_similarity(a, b))]
    left, right, got = set(), set(), 0.0
    for _, s, i, j in sorted(links, reverse=True):
        if i not in left and j not in right:
            left.add(i)
            right.add(j)
            got += s * (x[i][1] + y[j][1])
    return got / total


UNKNOWN = 0.6


def weighted(parts: list[tuple[float, np.ndarray]]) -> np.ndarray:
    """Mean of similarities by weight over many pairs; a missing one (NaN) counts as ``UNKNOWN`` at half its weight."""
    got = weight = 0.0
    for w, s in parts:
        there = ~np.isnan(s)
        got = got + np.where(there, w * s, w / 2 * UNKNOWN)
        weight = weight + np.where(there, w, w / 2)
    return got / weight


def agreement(x: np.ndarray, y: np.ndarray, scale: list[float]) -> np.ndarray:
    """Similarity of numbers by their difference, 0 beyond the scale; NaN where one is missing."""
    gap = np.abs(x - y)
    at = np.where(gap < len(scale), np.nan_to_num(gap), len(scale)).astype(int)
    return np.where(np.isnan(gap), np.nan, np.array([*scale, 0.0])[at])


def same_code(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """1 and 0 for equal and unequal codes; NaN where one is missing."""
    return np.where(np.isnan(x) | np.isnan(y), np.nan, (x == y).astype(float))


#: Country spellings that name the same country (fixed values), after folding.
COUNTRIES = {"turkiye": "turkey", "bosnia and herzegovina": "bosnia-herzegovina", "republic of ireland": "ireland", "czechia": "czech republic", "usa": "united states", "south korea": "korea, south", "korea republic": "korea, south", "cote d'ivoire": "ivory coast", "macedonia": "north macedonia", "holland": "netherlands", "uae": "united arab emirates", "cabo verde": "cape verde", "dr congo": "congo dr", "the gambia": "gambia", "faroes": "faroe islands", "faroe isles": "faroe islands"}
#: Forms of club kinds (fixed values), after folding.
KINDS = {"football club": "fc", "futbol club": "fc", "sport klub": "sk", "sports klub": "sk", "sporting club": "sc", "sport club": "sc", "idrottsforening": "if", "idrottsforeningen": "if", "fudbalski klub": "fk", "fotbal klub": "fk", "athletic club": "ac", "associazione calcio": "ac", "club de futbol": "cf", "union deportiva": "ud", "associazione sportiva": "as", "association sportive": "as", "boldklub": "bk", "boldklubben": "bk", "club deportivo": "cd"}
RESERVE = r"(?i)(?:\bu-?\d{2}\b|\bii\b|\biii\b|\bb\s*$|\breserves?\b|\byouth\b|\bjuvenil\b|\bjuniors?\b|\bacademy\b|\bprimavera\b)"
ROLE_CLASSES = {"goalkeeper": "g", "keeper": "g", "back": "d", "defender": "d", "winger": "a", "striker": "a", "forward": "a", "midfield": "m", "midfielder": "m"}


def country(name: str | None) -> str:
    from pampero.functions.text import fold

    c = re.sub(r"\s+", " ", fold(name or "")).strip(" .")
    return COUNTRIES.get(c, c)


def club_tokens(name: str | None) -> list[str]:
    """Tokens of a club's name: folded, kinds in one form, years left out; abbreviations are met by their similarity."""
    from pampero.functions.text import fold

    t = re.sub(r"[^a-z0-9]+", " ", fold(name or "")).strip()
    for long, short in KINDS.items():
        t = re.sub(rf"\b{long}\b", short, t)
    return [x for x in t.split() if not re.fullmatch(r"(?:18|19|20)\d{2}", x)]


def person_tokens(name: str | None) -> list[str]:
    """Tokens of a person's name, 'Family, Given' turned round."""
    from pampero.functions.text import fold

    t = fold(name or "")
    if t.count(",") == 1:
        family, given = t.split(",")
        t = f"{given} {family}"
    return re.sub(r"[^a-z0-9]+", " ", t).split()


def skeleton(token: str) -> str:
    return token[:1] + re.sub(r"[aeiouy]", "", token[1:])


def role_class(label: str | None) -> str:
    words = re.findall(r"[a-z]+", (label or "").lower())
    return next((ROLE_CLASSES[w] for w in reversed(words) if w in ROLE_CLASSES), "")


def name_likeness(x: str, y: str) -> float:
    """Of two people's tokens the shorter name's are each laid on the likest token left of the longer; names of unequal length lose a little."""
    a, b = x.split(), y.split()
    if not a or not b:
        return 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    free, total, left = list(long), 0.0, len(short)
    for t in short:
        at, best = 0, 0.0
        for i, u in enumerate(free):
            got = token_similarity(t, u)
            if got > best:
                at, best = i, got
        total += best
        left -= 1
        if total + left < 0.6 * len(short):
            return 0.0  # even equal tokens can't make up for it
        del free[at]
    name = total / len(short)
    return 0.0 if name < 0.6 else name * (1.0 if len(long) == len(short) else 0.95 if len(short) > 1 else 0.88)


def club_likeness(x: str, y: str) -> float:
    """Soft overlap of two clubs' tokens given as token:weight."""
    a, b = ([(t, float(w)) for t, w in (p.rsplit(":", 1) for p in v.split())] for v in (x, y))
    return soft_overlap(a, b)


def people_confidence(name: np.ndarray | float, place: np.ndarray, x: dict, y: dict) -> np.ndarray:
    """Confidence that pairs of people are one: name, shared country, birth year, height, foot and role by weight."""
    name = np.broadcast_to(np.asarray(name, float), place.shape)
    return weighted([(0.40, name), (0.16, place), (0.18, agreement(x["nacido"], y["nacido"], [1.0, 0.9, 0.3])), (0.14, agreement(x["altura"], y["altura"], [1.0, 0.85, 0.5])), (0.05, same_code(x["pie_c"], y["pie_c"])), (0.07, same_code(x["rol_c"], y["rol_c"]))])


def scored(pairs: DataFrame, records: DataFrame, fields: list[str], score: Callable[[pd.DataFrame], np.ndarray], least: float) -> DataFrame:
    """Pairs of rids as pairs of entities with their confidence, those under ``least`` left out; ``score`` gets a batch with the fields as x_ and y_."""
    x = records.where("side = 'a'").select(F.col("rid").alias("a"), F.col("ent").alias("x_ent"), *[F.col(f).alias(f"x_{f}") for f in fields])
    y = records.where("side = 'b'").select(F.col("rid").alias("b"), F.col("ent").alias("y_ent"), *[F.col(f).alias(f"y_{f}") for f in fields])

    def run(frames):
        for f in frames:
            got = score(f) if len(f) else np.zeros(0)
            yield pd.DataFrame({"a": f["x_ent"], "b": f["y_ent"], "confianza": got})[got >= least]

    return pairs.join(y, "b").join(x, "a").drop("a", "b").mapInPandas(run, "a string, b string, confianza double")


def _likeness(f: Callable[[str, str], float], x: pd.Series, y: pd.Series) -> np.ndarray:
    """A similarity of two text columns, each different pair once."""
    known: dict[tuple, float] = {}
    out = np.zeros(len(x))
    for i, p in enumerate(zip(x, y)):
        got = known.get(p)
        if got is None:
            got = known[p] = f(*p)
        out[i] = got
    return out


# --- the sources -----------------------------------------------------------------------------

def club_records(names: DataFrame) -> DataFrame:
    """side, ent, nombre (tokens with weights), pais, keys of club names: (side, ent, name, country) rows, repeated ones allowed.

    A token weighs the logarithm of the clubs over the clubs that use it, counted over all names
    of both sides, so kinds of clubs weigh little and a proper name much.
    """
    tokens, same = mapped(club_tokens, "array<string>"), mapped(country, "string")
    base = names.where("name is not null and ent is not null").select("side", "ent", "name", "country").distinct()
    # names without tokens drop out when the tokens are laid in rows; a filter here would be pushed below the distinct and run the function on every row
    shown = written(base.select("side", "ent", "country", tokens("name").alias("t")), "mt-clubs")
    places = shown.groupBy("side", "ent").agg(F.mode("country", True).alias("country"))
    one = shown.select("side", "ent", "t").distinct()
    used = one.select("side", "ent", F.explode("t").alias("tok")).distinct().groupBy("tok").agg(F.count("*").alias("df"))
    n = one.select("side", "ent").distinct().count()
    each = one.withColumn("k", F.concat_ws(" ", "t")).select("side", "ent", "k", F.posexplode("t").alias("i", "tok")).join(used, "tok")
    w = F.round(F.log(F.lit(1.0 + n) / F.col("df")), 3)
    put = each.groupBy("side", "ent", "k").agg(F.array_sort(F.collect_list(F.struct("i", "tok", w.alias("w")))).alias("p"))
    put = put.select("side", "ent", F.concat_ws(" ", F.transform("p", lambda s: F.concat_ws(":", s["tok"], s["w"].cast("string")))).alias("nombre"), F.array_sort(F.transform("p", lambda s: F.struct((-s["w"]).alias("w"), (-F.length(s["tok"])).alias("l"), s["tok"].alias("tok")))).alias("q"))
    first, second = F.col("q")[0]["tok"], F.coalesce(F.get(F.col("q"), F.lit(1))["tok"], F.lit(""))
    bones = F.regexp_replace(first, "(?<=.)[aeiouy]", "")
    keys = F.array(F.concat_ws("|", first, "pais", second), F.concat_ws("|", "pais", first, second), F.concat_ws("|", "pais", F.reverse(first)), F.concat_ws("|", "pais", bones), F.concat_ws("|", bones, "pais"), F.concat_ws("|", "pais", F.array_join(F.array_sort(F.transform("q", lambda s: s["tok"])), " ")))
    return put.join(places, ["side", "ent"], "left").withColumn("pais", F.coalesce(same("country"), F.lit(""))).select("side", "ent", "nombre", "pais", keys.alias("keys"))


def match_clubs(names: DataFrame, window: int = 12, least: float = 0.8) -> DataFrame:
    """One-to-one ``a``, ``b``, ``confianza`` of clubs given as (side, ent, name, country) rows.

    Names and countries may be null, repeated or in several forms; an entity without any name
    stays alone, as do entities without a counterpart of at least ``least``. Ties go to the
    assignment's order of ids.
    """
    land = F.when(F.col("pais") != "", F.pmod(F.xxhash64("pais"), F.lit(1 << 40)).cast("double"))
    records = written(club_records(names).select(F.monotonically_increasing_id().alias("rid"), "*", land.alias("land")), "mt-records")

    def score(f: pd.DataFrame) -> np.ndarray:
        name = _likeness(club_likeness, f["x_nombre"], f["y_nombre"])
        known = (f["x_pais"] != "").to_numpy() & (f["y_pais"] != "").to_numpy()
        place = np.where(known, (f["x_pais"] == f["y_pais"]).to_numpy(dtype=float), np.nan)
        return np.where((place == 0.0) | (name < 0.5), 0.0, weighted([(0.85, name), (0.15, place)]))

    near = neighbours(records, "keys", ["land"], lambda x, y: ~(same_code(x["land"], y["land"]) == 0.0), window)
    return assign(scored(near, records, ["nombre", "pais"], score, least))


_ITEM = re.compile(r'"title"\s*:\s*"([^"]+)"\s*,\s*"value"\s*:\s*(\{[^{}]*\}|"(?:[^"\\]|\\.)*"|-?\d+(?:\.\d+)?)')


def profile_fields(text: str | None) -> dict[str, str]:
    """Title to value of a profile's information, even if cut off, given as text within text, or of mixed types."""
    if not text:
        return {}
    if '\\"' in text:
        text = text.replace("\\\\", "\\").replace('\\"', '"')
    out = {}
    for title, raw in _ITEM.findall(text):
        try:
            value = json.loads(raw)
        except ValueError:
            continue
        if isinstance(value, dict):
            value = next((v for v in (value.get("fallback"), value.get("numberValue"), value.get("key")) if v is not None), None)
        if value is not None:
            out.setdefault(title.strip().lower(), str(value))
    return out


def height_cm(text: str | None) -> int | None:
    """Centimetres out of '184 cm', '184cm', '1.84 m', '1,84' or 184."""
    m = re.search(r"(\d)[.,](\d{1,2})\s*m?\b|(\d{3})", text or "")
    if not m:
        return None
    return int(m[3]) if m[3] else int(m[1]) * 100 + int(m[2].ljust(2, "0"))


def profile(text: str) -> Column:
    """pais, edad, altura, pie of a profile's information, in Arrow batches; what is missing is null or empty."""

    @pandas_udf("struct<pais: string, edad: int, altura: int, pie: string>")
    def run(s: pd.Series) -> pd.DataFrame:
        got = [profile_fields(t) for t in s]
        ages = ["".join(c for c in g.get("age", "") if c.isdigit()) for g in got]
        whole = lambda xs: pd.array(xs, "Int32")
        return pd.DataFrame({"pais": [country(g.get("country")) for g in got], "edad": whole([int(a) if a and len(a) < 3 else None for a in ages]), "altura": whole([height_cm(g.get("height")) for g in got]), "pie": [g.get("preferred foot", "").lower() for g in got]})

    return run(text)


def people_records(people: DataFrame) -> DataFrame:
    """Numbered records of people with sort keys and codes for the neighbourhood."""
    known = ("paises", "pie", "rol")
    people = people.where("nombre <> '' and ent is not null").select("side", "ent", "nombre", "nacido", "altura", *[F.coalesce(c, F.lit("")).alias(c) for c in known])
    lands = F.array_remove(F.split("paises", r"\|"), "")
    code = lambda c: F.when(F.col(c) != "", F.pmod(F.xxhash64(c), F.lit(1 << 40)).cast("double"))
    # the keys follow from these columns: they are made once the repeated rows are gone
    base = people.select("side", "ent", "nombre", lands.alias("lands"), F.split("paises", r"\|")[0].alias("place"), "nacido", "altura", code("pie").alias("pie_c"), code("rol").alias("rol_c")).distinct()
    tokens, place = F.split("nombre", " "), F.col("place")
    last, given = F.element_at(tokens, -1), tokens[0]
    born, tall = F.coalesce(F.col("nacido").cast("string"), F.lit("")), F.coalesce(F.col("altura").cast("string"), F.lit(""))
    bones = F.regexp_replace(last, "(?<=.)[aeiouy]", "")
    full = (place != "") & (born != "")
    keys = F.array(
        F.concat_ws("|", last, given, place, born), F.concat_ws("|", last, place, born, tall), F.when(place != "", F.concat_ws("|", given, place, born, tall)),
        F.when(full, F.concat_ws("|", place, born, tall, last)), F.when(full, F.concat_ws("|", place, born, bones, given)), F.concat_ws("|", bones, given, place),
        F.when(place != "", F.concat_ws("|", place, F.coalesce(F.get(tokens, F.lit(1)), last), born)), F.when(born != "", F.concat_ws("|", given, born, tall, last)), F.when(born != "", F.concat_ws("|", last, born, tall, given)),
    )
    land = lambda i: F.pmod(F.xxhash64(F.get(F.col("lands"), F.lit(i))), F.lit(1 << 40)).cast("double")
    base = base.select("side", "ent", "nombre", "lands", F.col("nacido").cast("double").alias("nacido"), F.col("altura").cast("double").alias("altura"), "pie_c", "rol_c", keys.alias("keys"))
    n = F.size("lands")
    return written(base.select(F.monotonically_increasing_id().alias("rid"), "*", F.when(n > 0, land(0)).alias("l0"), F.when(n > 1, land(1)).alias("l1"), (n > 2).cast("double").alias("more")), "mt-people")


def possible_people(x: dict, y: dict, least: float) -> np.ndarray:
    """Which pairs would reach a confidence if their names were equal, by their codes."""
    known = ~np.isnan(x["l0"]) & ~np.isnan(y["l0"])
    shared = (x["l0"] == y["l0"]) | (x["l0"] == y["l1"]) | (x["l1"] == y["l0"]) | (x["l1"] == y["l1"]) | (x["more"] + y["more"] > 0)
    return people_confidence(1.0, np.where(known, shared.astype(float), np.nan), x, y) >= least - 1e-9


def score_people(f: pd.DataFrame) -> np.ndarray:
    """Confidence of a batch of pairs."""
    known = (f["x_lands"].map(len) > 0).to_numpy() & (f["y_lands"].map(len) > 0).to_numpy()
    shared = np.fromiter((not set(p).isdisjoint(q) for p, q in zip(f["x_lands"], f["y_lands"])), bool, len(f))
    sides = [{c: f[f"{s}_{c}"].to_numpy(dtype=float) for c in ("nacido", "altura", "pie_c", "rol_c")} for s in "xy"]
    name = _likeness(name_likeness, f["x_nombre"], f["y_nombre"])
    return np.where(name > 0, people_confidence(name, np.where(known, shared.astype(float), np.nan), *sides), 0.0)


#: What tells at once that two people can't be one, and what their confidence is made of.
CODES = ["l0", "l1", "more", "nacido", "altura", "pie_c", "rol_c"]
PEOPLE = ["nombre", "lands", "nacido", "altura", "pie_c", "rol_c"]


def people_pairs(records: DataFrame, window: int, least: float) -> DataFrame:
    """All pairs of the neighbourhood with at least a confidence, before the assignment."""
    near = neighbours(records, "keys", CODES, lambda x, y: possible_people(x, y, least), window)
    return scored(near, records, PEOPLE, score_people, least)


def match_people(people: DataFrame, window: int = 12, least: float = 0.77) -> DataFrame:
    """One-to-one ``a``, ``b``, ``confianza`` of people given as side, ent, nombre (tokens), paises (by '|'), nacido, altura, pie, rol.

    Missing attributes count neither for nor against; entities without a name or a counterpart of
    at least ``least`` stay alone; several rows of an entity are several records of it.
    """
    return assign(people_pairs(people_records(people), window, least))
