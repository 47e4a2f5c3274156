"""Keys without collisions: every claimant gets its base or the first free suffix, earlier claimants first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstack.functions.keys import alpha_suffix


def candidate(base: Column, n: Column, policy: str) -> Column:
    """The n-th key to try: the base for -1, then suffixes (a, b, ... or -2, -3, ...)."""
    suffix = alpha_suffix(n) if policy == "alpha" else F.concat(F.lit("-"), (n + 2).cast("string"))
    return F.when(n < 0, base).otherwise(F.concat(base, suffix))


def disambiguate(claims: DataFrame, taken: DataFrame, policy: str = "alpha") -> DataFrame:
    """(base, ord, key) for claims (base, ord; ord unique) against the keys of ``taken`` (citekey).

    The outcome is that of serving claims one after another by ``ord``. Within a base the r-th claim can't do better than
    the r-th candidate, so it starts there; then all propose at once, a key goes to the earliest claim that proposes it,
    the others move on, until nobody has to. Usually that takes two or three rounds. ``error`` as policy raises
    ValueError if a key is claimed twice or taken."""
    n = F.row_number().over(W.partitionBy("base").orderBy("ord")).cast("bigint") - 2
    state = claims.select("base", "ord").withColumn("n", n)
    used = taken.select(F.col("citekey").alias("key"), F.lit(True).alias("used")).distinct()
    while True:
        tried = state.withColumn("key", candidate(F.col("base"), F.col("n"), "alpha" if policy == "error" else policy)).join(used, "key", "left")
        first = F.min(F.when(F.col("used").isNull(), F.col("ord"))).over(W.partitionBy("key"))
        tried = tried.withColumn("free", F.col("used").isNull() & (F.col("ord") == first)).drop("used").persist()
        lost = tried.where(~F.col("free")).limit(1).count()
        if policy == "error" and (lost or tried.where("n >= 0").limit(1).count()):
            raise ValueError("a key is already taken")
        if not lost:
            return tried.select("base", "ord", "key")
        state = tried.select("base", "ord", F.when(F.col("free"), F.col("n")).otherwise(F.col("n") + 1).alias("n"))


def new_documents(incoming: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents whose key is valid and free, refused ones with a reason) of a create."""
    from quillstack.functions.labels import problem

    judged = incoming.join(index.select("citekey", F.lit(True).alias("_there")), "citekey", "left")
    reason = F.coalesce(problem(F.col("citekey")), F.when(F.col("_there"), "exists"))
    judged = judged.withColumn("reason", reason).drop("_there")
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")
