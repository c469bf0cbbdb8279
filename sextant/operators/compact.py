"""Token-budgeted context assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.config import DEFAULTS
from sextant.functions import text as T


def block(domain: Column, fqn: Column, id_: Column, title: Column, path: Column, section: Column, snippet: Column) -> Column:
    code = F.concat(F.lit("// "), F.coalesce(fqn, id_), F.lit("\n"), snippet)
    heading = F.coalesce(title, path)
    shown = F.when(section.isNotNull() & (F.trim(section) != ""), F.concat(heading, F.lit(" > "), section)).otherwise(heading)
    return F.when(domain == "CODE", code).otherwise(F.concat(F.lit("## "), shown, F.lit("\n"), snippet))


def compact(hits: DataFrame, budget: int = DEFAULTS.budget_tokens, chars_per_token: int = DEFAULTS.chars_per_token, floor: int = DEFAULTS.min_tokens_per_hit) -> DataFrame:
    """One row (context, used_tokens, n_hits) from ranked hits (at most a search's k rows, with rank).

    Each hit may take what the budget leaves after floor tokens for every hit to come,
    and at least floor; so the whole may exceed the budget by floor per hit. A budget of
    zero or less stands for the default. No hits give an empty context.
    """
    budget = budget if budget > 0 else DEFAULTS.budget_tokens
    c = F.col
    shown = block(c("domain"), c("fqn"), c("id"), c("title"), c("path"), c("section"), F.coalesce(c("snippet"), F.lit("")))
    listed = hits.select("rank", shown.alias("b")).agg(F.sort_array(F.collect_list(F.struct("rank", "b"))).alias("h"))
    indexed = listed.select(F.transform("h", lambda x, i: F.struct(i.alias("i"), x["b"].alias("b"))).alias("h"), F.size("h").alias("n"))
    zero = F.struct(F.lit("").alias("text"), F.lit(0).alias("used"), F.lit(0).alias("kept"))

    def step(s: Column, x: Column) -> Column:
        room = F.greatest(F.lit(floor), F.lit(budget) - s["used"] - F.lit(floor) * (c("n") - x["i"] - 1))
        cost = T.token_estimate(x["b"], chars_per_token)
        fits = F.when(cost <= room, x["b"]).otherwise(T.truncate_to_fit(x["b"], room, chars_per_token))
        keep = (s["used"] < budget) & (F.trim(fits) != "")
        text = F.when(s["kept"] == 0, fits).otherwise(F.concat(s["text"], F.lit("\n\n"), fits))
        grown = F.struct(text.alias("text"), (s["used"] + T.token_estimate(fits, chars_per_token)).alias("used"), (s["kept"] + 1).alias("kept"))
        return F.when(keep, grown).otherwise(s)

    done = indexed.select(F.aggregate("h", zero, step).alias("s"))
    return done.select(F.regexp_replace("s.text", r"\s+$", "").alias("context"), F.col("s.used").alias("used_tokens"), F.col("s.kept").alias("n_hits"))
