"""Enrichment operators.

Set-based shape: distinct keys -> join lookup tables -> rank -> join back.
Picks inside a record's own nested array (lead actor, director, producer)
are higher-order functions evaluated row-locally — no shuffle at all.
Picks across rows are ``min_by``/``max_by`` aggregates, which reduce a hot
key map-side.  Ranking inside a possibly huge group (franchise position)
uses a range-partitioned global rank minus the group's first rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.clean import first_part, is_blank
from marquee.operators.keys import keep_first, surrogate_key

# --- fixed values: role priority of the producer pick (lower = preferred)
PRODUCER_ROLES = ("producer", "co-producer", "executive producer")
MISSING_ORDER = 9999          # cast order used when it is missing
MISSING_DATE = "9999-99-99"   # release date used when it is missing


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lead_actor(cast) -> Column:
    """E5: cast member with the lowest ``order`` (missing -> 9999), ties by
    position in the list."""
    ranked = F.transform(_c(cast), lambda x, i: F.struct(
        F.coalesce(x["order"], F.lit(MISSING_ORDER)).alias("o"), i.alias("pos"),
        x["id"].alias("id"), x["name"].alias("name")))
    return F.get(F.array_sort(ranked), 0)


def lead_director(crew, job: str = "Director") -> Column:
    """First crew entry whose job is ``job``."""
    return F.get(F.filter(_c(crew), lambda x: x["job"] == F.lit(job)), 0)


def role_priority(job, roles=PRODUCER_ROLES) -> Column:
    j = F.lower(F.trim(_c(job)))
    expr = None
    for i, r in enumerate(roles):
        expr = F.when(j == F.lit(r), F.lit(i)) if expr is None else expr.when(j == F.lit(r), F.lit(i))
    return expr


def lead_producer(crew, roles=PRODUCER_ROLES) -> Column:
    """Best producer by role priority, then list position (job text
    trimmed and case-folded)."""
    ranked = F.transform(_c(crew), lambda x, i: F.struct(
        role_priority(x["job"], roles).alias("p"), i.alias("pos"), x["id"].alias("id"), x["name"].alias("name")))
    return F.get(F.array_sort(F.filter(ranked, lambda x: x["p"].isNotNull())), 0)


def source_value(ratings, source: str) -> Column:
    """H4: ``Value`` of the first rating entry from ``source``."""
    return F.get(F.filter(_c(ratings), lambda r: r["Source"] == F.lit(source)), 0)["Value"]


def json_roundtrip(arr, schema: str) -> Column:
    """H1: encode a nested column as JSON text and decode it again."""
    return F.from_json(F.to_json(_c(arr)), schema)


def franchise_position(parts: DataFrame, group: str = "collection_id", item: str = "movie_id",
                       date: str = "release_date", pos: str = "pos") -> DataFrame:
    """Position and size of each item inside its group, ordered by
    release date (missing last) then list position.

    position = global rank (range-partitioned, see ``surrogate_key``) minus
    the group's first global rank: a hot group is split across partitions
    instead of landing in one window task."""
    keyed = parts.select(group, item, pos,
                         F.coalesce(F.when(~is_blank(date), F.col(date)), F.lit(MISSING_DATE)).alias("_dk"))
    ranked = surrogate_key(keyed, [group, "_dk", pos, item], "_rk", dtype="long")
    bounds = ranked.groupBy(group).agg(F.min("_rk").alias("_first"), F.count(F.lit(1)).alias("franchise_total"))
    j = ranked.join(bounds, group)
    return j.select(group, item, (F.col("_rk") - F.col("_first") + 1).cast("int").alias("franchise_position"),
                    "franchise_total")


def franchise_flags(movies: DataFrame, positions: DataFrame, item: str = "movie_id") -> DataFrame:
    """Sequel = position > 1; prequel = first of a group of more than one;
    no group -> both 'No'."""
    j = movies.select(item).join(positions.drop("collection_id"), item, "left")
    pos, tot = F.col("franchise_position"), F.col("franchise_total")
    yes_no = lambda c: F.when(c, F.lit("Yes")).otherwise(F.lit("No"))
    return j.select(item, "franchise_position", "franchise_total",
                    yes_no(pos.isNotNull() & (pos > 1)).alias("is_sequel"),
                    yes_no(pos.isNotNull() & (pos == 1) & (tot > 1)).alias("is_prequel"))


def choose_company(details: DataFrame, companies: DataFrame, countries: DataFrame | None = None) -> DataFrame:
    """C14 (+B8, B25, C13): first listed company that has a city or a
    country code in the company lookup, else the first listed; its city,
    country code (lookup, falling back to the record's own) and continent."""
    ex = details.select("movie_id", F.posexplode("production_companies").alias("pos", "c"))
    cmp = companies.select(F.col("company_id"), F.col("headquarters"),
                           F.col("origin_country").alias("lookup_country"))
    j = ex.join(cmp, ex["c.id"] == cmp["company_id"], "left")
    city = first_part(F.col("headquarters"))
    iso = F.coalesce(F.col("lookup_country"), F.col("c.origin_country"))
    has_geo = city.isNotNull() | iso.isNotNull()
    row = F.struct(F.col("c.id").alias("company_id"), F.col("c.name").alias("company_name"),
                   city.alias("city"), iso.alias("iso2"))
    best = j.groupBy("movie_id").agg(F.min_by(row, F.struct((~has_geo).alias("g"), F.col("pos"))).alias("b"))
    out = best.select("movie_id", "b.*")
    if countries is not None:
        ct = countries.select(F.upper("iso2").alias("_iso"), "continent")
        out = out.join(ct, (F.length("iso2") == 2) & (F.upper(F.col("iso2")) == ct["_iso"]), "left").drop("_iso")
    return out


def first_geo_binding(geo: DataFrame, key: str = "name", pos: str = "pos") -> DataFrame:
    """First binding (by position) that has any of hq / country / iso2."""
    g = geo.filter(F.col("hq").isNotNull() | F.col("country").isNotNull() | F.col("iso2").isNotNull())
    row = F.struct(F.col(pos), "hq", "country", "iso2")
    return g.groupBy(key).agg(F.min_by(row, F.col(pos)).alias("b")).select(key, "b.*")


def binding_geography(geo: DataFrame, countries: DataFrame) -> DataFrame:
    """(name, city, iso2, continent) of the first binding of each name
    that says anything; where it has no country code, the code comes from its
    country label."""
    label = countries.groupBy(F.lower(F.trim("name")).alias("_label")).agg(F.min(F.upper("iso2")).alias("_iso"))
    b = first_geo_binding(geo).join(label, F.lower(F.trim("country")) == F.col("_label"), "left")
    iso = F.coalesce(F.upper(F.when(~is_blank("iso2"), F.trim("iso2"))), F.col("_iso"))
    b = b.select("name", F.when(~is_blank("hq"), F.trim("hq")).alias("city"), iso.alias("iso2"))
    ct = countries.groupBy(F.upper("iso2").alias("_code")).agg(F.min("continent").alias("continent"))
    return b.join(ct, F.col("iso2") == F.col("_code"), "left").select("name", "city", "iso2", "continent")


def company_geography(rows: DataFrame, key: str, chosen: DataFrame, geo: DataFrame, countries: DataFrame) -> DataFrame:
    """City and continent of each row's company by a chain of lookups, with
    the source of each value.

    ``rows``: ``key``, city and continent as far as known, country (a label)
    and main_studio; ``chosen``: ``key``, company_name, city, continent, the
    company picked from the movie record.  In order: what is known; the chosen
    company; the binding of that company, or where there is none of the main
    studio, asked only if the company lacks city or continent; for the
    continent last the country label."""
    c = chosen.select(F.col(key).alias("_key"), "company_name", F.col("city").alias("_c_city"), F.col("continent").alias("_c_continent"))
    j = rows.join(c, rows[key] == F.col("_key"), "left").withColumn("_name", F.coalesce("company_name", "main_studio"))
    b = binding_geography(geo, countries).select(F.col("name").alias("_b_name"), F.col("city").alias("_b_city"), F.col("continent").alias("_b_continent"))
    j = j.join(b, F.col("_name") == F.col("_b_name"), "left")
    asked = F.col("_c_city").isNull() | F.col("_c_continent").isNull()
    label = countries.groupBy(F.lower(F.trim("name")).alias("_label")).agg(F.min("continent").alias("_l_continent"))
    j = j.join(label, F.lower(F.trim("country")) == F.col("_label"), "left")
    out = [F.col(key), F.col("_name").alias("geo_company")]
    chains = {"city": [("known", F.col("city")), ("company", F.col("_c_city")), ("binding", F.when(asked, F.col("_b_city")))],
              "continent": [("known", F.col("continent")), ("company", F.col("_c_continent")), ("binding", F.when(asked, F.col("_b_continent"))), ("country", F.col("_l_continent"))]}
    for name, chain in chains.items():
        source = F.lit(None).cast("string")
        for label_, value in reversed(chain):
            source = F.when(value.isNotNull(), F.lit(label_)).otherwise(source)
        out += [F.coalesce(*[v for _, v in chain]).alias(name), source.alias(f"{name}_source")]
    return j.select(*out)


def most_frequent(df: DataFrame, key: str, value: str, name: str, rows: Column | None = None) -> DataFrame:
    """Most frequent ``value`` per ``key``; ties -> smallest value.
    ``rows``: how many rows each row stands for, where ``df`` was reduced."""
    n = F.count(F.lit(1)) if rows is None else F.sum(rows)
    c = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(n.alias("_n"))
    return c.groupBy(key).agg(F.min_by(F.col(value), F.struct(-F.col("_n"), F.col(value))).alias(name),
                              F.max("_n").alias(f"{name}_days"))


def best_by_popularity(people: DataFrame, name: str = "name", pop: str = "popularity",
                       ident: str = "person_id") -> DataFrame:
    """Per searched name, the hit with the highest popularity (missing
    = 0), ties -> smallest id."""
    others = [c for c in people.columns if c != name]
    row = F.struct(*[F.col(c) for c in others])
    best = people.groupBy(name).agg(
        F.max_by(row, F.struct(F.coalesce(F.col(pop), F.lit(0.0)), -F.col(ident))).alias("b"))
    return best.select(name, "b.*")


def lookup_fill(df: DataFrame, on: list[str], sources: list[tuple[DataFrame, Column]], name: str,
                existing: Column | None = None) -> DataFrame:
    """Fill one attribute from several lookups in priority order.
    Each source is (frame keyed by ``on``, value column on that frame); a
    NULL (or a value the caller mapped to NULL) falls through to the next.
    A key that a source holds more than once gives its least value."""
    out, vals = df, []
    for i, (src, val) in enumerate(sources):
        s = src.select(*[F.col(k).alias(f"_s{i}_{k}") for k in on], val.alias(f"_v{i}"))
        s = s.groupBy(*[f"_s{i}_{k}" for k in on]).agg(F.min(f"_v{i}").alias(f"_v{i}"))
        cond = None
        for k in on:
            c = out[k].eqNullSafe(s[f"_s{i}_{k}"])
            cond = c if cond is None else cond & c
        out = out.join(s, cond, "left").drop(*[f"_s{i}_{k}" for k in on])
        vals.append(F.col(f"_v{i}"))
    chain = ([existing] if existing is not None else []) + vals
    src_name = F.when(F.lit(False), F.lit(None))
    labels = (["existing"] if existing is not None else []) + [f"source_{i + 1}" for i in range(len(vals))]
    for c, lbl in zip(chain, labels, strict=True):
        src_name = src_name.when(c.isNotNull(), F.lit(lbl))
    return out.select(*df.columns, F.coalesce(*chain).alias(name), src_name.alias(f"{name}_source"))


def cache_upsert(old: DataFrame, new: DataFrame, keys: list[str], tie: list[str]) -> DataFrame:
    """New entries replace old ones with the same key; one row per key
    (ties inside one side by ``tie`` ascending).  Idempotent."""
    u = (old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1))))
    order = [-F.col("_new")] + [F.col(t) for t in tie]
    return keep_first(u, keys, order).drop("_new")


def cache_hits(rows: DataFrame, cache: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Cache lookup on keys, NULL-safe (a NULL year matches a NULL
    year [decision])."""
    c = cache.select(*[F.col(k).alias(f"_c_{k}") for k in keys], F.col(value).alias(f"cached_{value}"))
    cond = None
    for k in keys:
        e = rows[k].eqNullSafe(c[f"_c_{k}"])
        cond = e if cond is None else cond & e
    j = rows.join(c, cond, "left")
    return j.select(*rows.columns, f"cached_{value}",
                    F.col(f"cached_{value}").isNotNull().alias("cache_hit"))


def fresh_rows(existing: DataFrame, batch: DataFrame, keys: list[str], range_col: str | None = None) -> DataFrame:
    """Rows of ``batch`` whose composite key (NULLs equal) is not in
    ``existing``; of rows that share a key within the batch the least stays.

    With ``range_col``, one of the keys, only loaded rows inside the batch's
    span of it are compared: a pushed-down range filter, which lets loaded
    NULLs through whenever the batch holds NULLs."""
    if range_col:
        lo, hi, nulls = batch.agg(F.min(range_col), F.max(range_col), F.count_if(F.col(range_col).isNull())).first()
        near = F.lit(False) if lo is None else F.col(range_col).between(lo, hi)
        existing = existing.filter(near | F.col(range_col).isNull() if nulls else near)
    k = existing.select(*[F.col(c).alias(f"_e_{c}") for c in keys]).distinct()
    cond = None
    for c in keys:
        e = batch[c].eqNullSafe(k[f"_e_{c}"])
        cond = e if cond is None else cond & e
    rest = [c for c in batch.columns if c not in keys]
    fresh = batch.join(k, cond, "left_anti")
    if not rest:
        return fresh.distinct()
    once = fresh.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row"))
    return once.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in batch.columns])


def append_new(existing: DataFrame, batch: DataFrame, keys: list[str], range_col: str | None = None) -> DataFrame:
    """``existing`` with the fresh rows of ``batch``."""
    return existing.unionByName(fresh_rows(existing, batch, keys, range_col))
