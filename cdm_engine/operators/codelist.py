"""Matching the codes found in the data to a study codelist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import saved

#: Hierarchical coding systems, in which a study code stands for all codes that it begins.
PREFIX_SYSTEMS = ("ICD10CM", "ICD10", "ICD10DA", "ICD9CM", "MTHICD9", "ICPC", "ICPC2P", "ICPC2EENG", "ATC")

MATCHED, ONLY_IN_DATA, ONLY_IN_CODELIST = "MATCHED", "ONLY_IN_DATA", "ONLY_IN_CODELIST"


def _checked(df: DataFrame, what: str, needed: list[str]) -> DataFrame:
    lacking = [c for c in needed if c not in df.columns]
    if lacking:
        raise ValueError(f"{what} lacks {lacking}")
    if not isinstance(df.schema["code"].dataType, T.StringType):
        raise ValueError(f"{what}: code is text")
    return df


class ExplosiveMatch(ValueError):
    """Equal codes on both sides would multiply beyond the limit."""


#: Codes that a refusal names.
TOP = 5


def _per_code(data: DataFrame, study: DataFrame) -> DataFrame:
    """(coding_system, code, n, m, rows): rows of each code on either side and in a join of them. Each side is counted per code
    where it lies; the counts meet in one aggregate, and nothing is joined."""
    none = F.lit(0).cast("long")
    n, m = (df.groupBy("coding_system", "code").agg(F.count(F.lit(1)).alias("c")) for df in (data, study))
    both = n.select("coding_system", "code", F.col("c").alias("n"), none.alias("m")).unionAll(m.select("coding_system", "code", none.alias("n"), F.col("c").alias("m")))
    return both.groupBy("coding_system", "code").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).withColumn("rows", F.col("n").cast("decimal(19,0)") * F.col("m"))


def predict_exact(data: DataFrame, study: DataFrame) -> DataFrame:
    """One row: the rows on either side (``data_rows``, ``study_rows``) and those that a join on equal codes (NULL equals NULL) would
    have (``predicted``). Both sides have coding_system and code."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias
    return _per_code(data, study).agg(total("n")("data_rows"), total("m")("study_rows"), total("rows")("predicted"))


def check_exact(data: DataFrame, study: DataFrame, max_rows: int | None = None) -> int:
    """The predicted rows of the exact join. More than ``max_rows``, by default the rows of both sides together, is an ExplosiveMatch."""
    r = predict_exact(data, study).first()
    limit = int(r.data_rows + r.study_rows) if max_rows is None else max_rows
    if r.predicted > limit:
        top = _per_code(data, study).orderBy(F.desc("rows"), "coding_system", "code").limit(TOP).collect()
        raise ExplosiveMatch(f"equal codes would give {r.predicted} rows of {r.data_rows} and {r.study_rows}; the limit is {limit} (most from {', '.join(f'{h.coding_system} {h.code}: {h.rows}' for h in top)})")
    return int(r.predicted)


def match_codelist(
    found: DataFrame, codelist: DataFrame, prefix_systems: tuple[str, ...] = PREFIX_SYSTEMS, priority: str = "priority", position: str | None = None, guard: bool = True, max_rows: int | None = None
) -> DataFrame:
    """Each code of the data with its study codes, each code of either side without one, and a status.

    Exact systems: equal codes (NULL equals NULL), all concepts kept. Prefix systems: a code is expanded
    to its prefixes of lengths that occur among study codes and hash-joined; per code, concept and system
    the longest study code stays, then the lowest priority (NULL first), then the first listed
    (``position``, a column of the codelist; else its order). ``guard``: exact codes that would multiply beyond ``max_rows`` are refused
    before they are joined (``check_exact``).

    Both inputs are read once and written to the shared folder. An outer join of equal codes and a join of distinct codes by their prefixes
    find matches and data codes alone; no rows of a data code gather in one task. Codes of the list that no data code picked are found by an anti-join with the picked ones, as many
    data codes may meet in one study code.
    """
    found = _checked(found, "the data's codes", ["coding_system", "code", "COUNT", "source_column"])
    codelist = _checked(codelist, "the codelist", ["coding_system", "code", "concept_id"])
    data = saved(found.select("coding_system", "code", "COUNT", "source_column"), "inventory")
    study = saved(
        codelist.select(
            "coding_system",
            "code",
            "concept_id",
            (F.col("tags") if "tags" in codelist.columns else F.lit(None).cast("string")).alias("tags"),
            (F.col(priority) if priority in codelist.columns else F.lit(1)).alias("rank"),
            (F.col(position) if position else F.monotonically_increasing_id()).alias("place"),
        ),
        "codelist",
    )
    hierarchical = F.coalesce(F.col("coding_system").isin(*prefix_systems), F.lit(False))
    if guard:
        check_exact(data.where(~hierarchical), study.where(~hierarchical), max_rows)
    pairs = saved(_paired(data, study, hierarchical), "matches")
    picked = pairs.where("picked").select(F.col("study_system").alias("s"), F.col("study_code").alias("c")).distinct()
    out = ["coding_system", "COUNT", "source_column", "data_code", "concept_id", "study_code", "tags", "rank", "study_length"]
    from_data = pairs.where("picked").select(*out, F.lit(MATCHED).alias("match_status"))
    alone = pairs.where("not picked").select(*out[:4], *[F.lit(None).cast(pairs.schema[c].dataType).alias(c) for c in out[4:]], F.lit(ONLY_IN_DATA).alias("match_status"))
    listed = study.join(picked, F.col("coding_system").eqNullSafe(F.col("s")) & F.col("code").eqNullSafe(F.col("c")), "left_anti")
    unused = listed.select(
        "coding_system", F.lit(None).cast("long").alias("COUNT"), *[F.lit(None).cast("string").alias(c) for c in ("source_column", "data_code")], "concept_id", F.col("code").alias("study_code"), "tags", "rank",
        F.length("code").alias("study_length"), F.lit(ONLY_IN_CODELIST).alias("match_status"),
    )
    return from_data.unionByName(alone).unionByName(unused).select(
        "coding_system", "COUNT", "source_column", F.col("data_code").alias("code.dap_codes"), "concept_id", F.col("study_code").alias("code.codelist"), "tags",
        F.col("rank").alias(priority), F.col("study_length").alias("length_str"),
        F.when(F.col("match_status") == MATCHED, F.col("data_code")).alias("code"), "match_status",
    )


def _paired(data: DataFrame, study: DataFrame, hierarchical: Column) -> DataFrame:
    """Rows of data and study codes: ``picked`` pairs are matches; the others are the data rows whose code has none, each once.

    Exact codes: rows of a code all match or none does, so a join is enough. Prefix codes: a window over each distinct code's study
    codes, which are few, and not over the rows of the data; the one row that gets a match is found by an aggregate."""
    system = F.coalesce("coding_system", F.lit("")).alias("key_system"), F.col("coding_system").isNull().alias("no_system")
    full = F.coalesce("code", F.lit("")).alias("key"), F.col("code").isNull().alias("no_code")
    key = ["key_system", "no_system", "key", "no_code"]
    of_study = F.struct("coding_system", "code", "concept_id", "tags", "rank", "place").alias("s")
    own = [F.col("coding_system"), F.col("code").alias("data_code"), "COUNT", "source_column"]
    theirs = [F.col("s.coding_system").alias("study_system"), F.col("s.code").alias("study_code"), "s.concept_id", "s.tags", "s.rank", F.length("s.code").alias("study_length")]
    told = lambda hit: hit.alias("picked")

    exact = data.where(~hierarchical).select(*own, *system, *full)
    exact = exact.join(study.where(~hierarchical).select(*system, *full, of_study), key, "left").select("coding_system", "data_code", "COUNT", "source_column", *theirs, told(F.col("s").isNotNull()))

    lengths = study.where(hierarchical).agg(F.sort_array(F.collect_set(F.length("code")))).scalar()
    some = data.where(hierarchical)
    order = F.struct(F.col("COUNT").isNull().alias("none"), (-F.col("COUNT").cast("decimal(20,0)")).alias("less"), "source_column")
    codes = some.where("code IS NOT NULL").groupBy("coding_system", "code").agg(F.min(F.struct(order.alias("order"), "COUNT", "source_column")).alias("best"))
    cut = codes.withColumn("lengths", lengths).withColumn("cut", F.explode(F.filter(F.col("lengths"), lambda n: n <= F.length("code"))))
    left = cut.select("coding_system", F.col("code").alias("data_code"), "best.COUNT", "best.source_column", F.expr("substring(code, 1, cut)").alias("prefix"))
    right = study.where(hierarchical & F.col("code").isNotNull()).select(F.col("coding_system").alias("system"), F.col("code").alias("own"), of_study)
    hits = left.join(right, (F.col("coding_system") == F.col("system")) & (F.col("prefix") == F.col("own")))
    best = W.partitionBy("coding_system", "data_code", "s.concept_id").orderBy(F.desc(F.length("s.code")), F.asc_nulls_first("s.rank"), "s.place")
    found = hits.withColumn("n", F.row_number().over(best)).where("n = 1").select("coding_system", "data_code", "COUNT", "source_column", *theirs, told(F.lit(True)))
    met = hits.select(F.col("coding_system").alias("met_system"), F.col("data_code").alias("met_code")).distinct()
    alone = some.join(met, (F.col("coding_system") == F.col("met_system")) & (F.col("code") == F.col("met_code")), "left_anti")
    nothing = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("study_system", "study_code", "concept_id", "tags", "rank", "study_length")]
    return exact.unionByName(found).unionByName(alone.select(*own, *nothing, told(F.lit(False))))
