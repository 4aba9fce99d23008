"""Annual fiscal panel, peer comparison, screening flags and domain assessments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesora.functions.scalar import parse_number, safe_ratio
from tesora.operators.forecast import keep_last
from tesora.operators.prefix import exact_median, value_ranks
from tesora.session import materialize

# Flag codes, titles and texts, domains and statuses.
FLAG_TITLES = {
    "income_shortfall": "Доходы ниже первоначального плана",
    "debt_peer_high": "Повышенная долговая нагрузка относительно peers",
    "amendments_peer_high": "Высокая частота изменений бюджета относительно peers",
    "quality_rank_peer": "Контекстный флаг официального ранга",
}
STRONG_FLAGS = ("income_shortfall", "debt_peer_high", "amendments_peer_high")
DOMAINS = (
    "Consumer Demand",
    "Income & Labour",
    "Cost of Living",
    "Business Activity",
    "Municipal Finance",
    "Economic Structure",
)
FISCAL_DOMAIN = "Municipal Finance"
NO_FLAGS_TEXT = (
    "По доступным Reference-признакам скрининговых флагов не выявлено. "
    "Это не означает состояние NORMAL: для него нужны временная устойчивость, "
    "калиброванный порог и подтверждение детекторами."
)
FLAGS_TEXT = (
    "Есть {n} скрининговых флаг(а): {names}. "
    "Это повод для наблюдения, но не подтвержденный структурный шок. "
    "Для WARNING/BREAK_CONFIRMED нужны persistence и независимое подтверждение."
)
FLAG_EXPLANATIONS = {
    "income_shortfall": "Отклонение {}: требуется внимание к доходной части.",
    "income_none": "Отрицательного отклонения от первоначального плана по доступному году нет.",
    "debt_peer_high": "Долговая нагрузка находится примерно на {} перцентиле.",
    "debt_none": "Недостаточно данных для peer-сравнения долговой нагрузки.",
    "amendments_peer_high": "Число изменений бюджета находится примерно на {} перцентиле.",
    "amendments_none": "Недостаточно данных для peer-сравнения числа изменений бюджета.",
    "quality_rank_peer": "Официальный ранг находится примерно на {} перцентиле; это контекстный флаг, а не доказательство экономического шока.",
    "rank_none": "Официальный ранг для сравнения недоступен.",
}
CORE_AMOUNTS = (
    "tax_initial",
    "nontax_initial",
    "tax_actual",
    "nontax_actual",
    "program_expense",
    "total_expense",
    "budget_amendments",
    "municipal_debt",
    "own_revenue_base",
)
PANEL_KEY = ("year", "municipality_name")
PEER_SHARE = 0.75


def _named(df: DataFrame) -> DataFrame:
    """Trimmed names; blank or digit-only names are not municipalities."""
    df = df.withColumns({"municipality_name": F.trim("municipality_name"), "year": F.col("year").cast("int")})
    return df.where((F.col("municipality_name") != "") & ~F.col("municipality_name").rlike("^[0-9]+$"))


def fiscal_panel(core: DataFrame, rankings: DataFrame, *, seq: str = "ingest_seq") -> DataFrame:
    """Core inputs with rankings and three ratios; per key the row with the highest ``seq`` wins."""
    left = keep_last(_named(core), PANEL_KEY, seq)
    left = left.withColumns({n: parse_number(n) for n in CORE_AMOUNTS})
    right = keep_last(_named(rankings), PANEL_KEY, seq)
    extras = [
        parse_number(c).alias(n) if c in right.columns else F.lit(None).cast("double").alias(n)
        for c, n in (("rank", "quality_rank"), ("article136_high_subsidy_flag", "article136_high_subsidy_flag"))
    ]
    source = F.col("source_file") if "source_file" in right.columns else F.lit("")
    right = right.select(*PANEL_KEY, *extras, source.alias("source_file"))
    c = F.col
    planned = c("tax_initial") + c("nontax_initial")
    actual = c("tax_actual") + c("nontax_actual")
    return left.join(right, list(PANEL_KEY), "left").select(
        *PANEL_KEY,
        F.lit("").alias("municipality_oktmo"),
        F.make_date("year", F.lit(12), F.lit(31)).alias("period_end"),
        F.lit("YEAR").alias("frequency"),
        safe_ratio(actual - planned, planned).alias("income_plan_deviation"),
        safe_ratio("program_expense", "total_expense").alias("program_expense_share"),
        "budget_amendments",
        safe_ratio("municipal_debt", "own_revenue_base").alias("debt_load"),
        "quality_rank",
        "article136_high_subsidy_flag",
        F.coalesce("source_file", F.lit("")).alias("source_file"),
        F.lit("derived_from_active_or_official_public").alias("data_status"),
    )


def peer_percentile(df: DataFrame, *, group: Sequence[str], value: str, out: str, pieces: int | None = None) -> DataFrame:
    """Share of peers with a value at or below the row's; NULL values get NULL and count for nobody."""
    ranks = value_ranks(df, group, value, pieces=pieces).select(*group, value, F.col("percentile_rank").alias(out))
    return df.join(ranks, [*group, value], "left")


def peer_median(df: DataFrame, *, group: Sequence[str], value: str, pieces: int | None = None) -> DataFrame:
    return exact_median(df, group, value, pieces=pieces)


def latest_row(df: DataFrame, *, entity: Sequence[str], order: str) -> DataFrame:
    """Newest row per entity."""
    return keep_last(df, entity, order)


def latest_values(df: DataFrame, *, entity: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Newest known value of every column per entity."""
    return df.groupBy(*entity).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    )


def _text(pattern: str, value: Column) -> Column:
    return F.concat(F.lit(pattern[: pattern.index("{}")]), value, F.lit(pattern[pattern.index("{}") + 2 :]))


def _percent(c: Column, digits: int = 0) -> Column:
    return F.concat(F.format_string(f"%.{digits}f", c * 100.0), F.lit("%"))


def screening_flags(panel: DataFrame, *, pieces: int | None = None) -> DataFrame:
    """Four flag rows per (year, municipality) against the peers of the same year."""
    df = materialize(panel, "screening_panel")
    for value, out in (
        ("debt_load", "debt_pct"),
        ("budget_amendments", "amend_pct"),
        ("quality_rank", "rank_pct"),
    ):
        df = peer_percentile(df, group=["year"], value=value, out=out, pieces=pieces)
    c = F.col
    no = F.lit(False)
    short = F.coalesce(c("income_plan_deviation") < 0, no)
    high_debt = F.coalesce((c("debt_pct") >= PEER_SHARE) & (c("debt_load") > 0), no)
    many = F.coalesce(c("amend_pct") >= PEER_SHARE, no)
    rank = F.coalesce(c("rank_pct") >= PEER_SHARE, no)

    def flag(code: str, active: Column, text: Column) -> Column:
        return F.struct(
            F.lit(code).alias("code"),
            F.lit(FLAG_TITLES[code]).alias("title"),
            active.alias("active"),
            text.alias("explanation"),
        )

    says = FLAG_EXPLANATIONS
    explained = {
        "income_shortfall": F.when(short, _text(says["income_shortfall"], _percent(c("income_plan_deviation"), 1))).otherwise(says["income_none"])
    }
    for code, share, none in (
        ("debt_peer_high", "debt_pct", "debt_none"),
        ("amendments_peer_high", "amend_pct", "amendments_none"),
        ("quality_rank_peer", "rank_pct", "rank_none"),
    ):
        explained[code] = F.when(c(share).isNull(), says[none]).otherwise(_text(says[code], _percent(c(share))))
    active = {"income_shortfall": short, "debt_peer_high": high_debt, "amendments_peer_high": many, "quality_rank_peer": rank}
    rows = F.array(*[flag(code, active[code], explained[code]) for code in FLAG_TITLES])
    return df.select(*PANEL_KEY, F.inline(rows))


def screening_conclusion(flags: DataFrame) -> DataFrame:
    """Active flag count, their titles and the conclusion text per (year, municipality)."""
    order = {code: i for i, code in enumerate(FLAG_TITLES)}
    position = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    entry = F.when(F.col("active"), F.struct(F.element_at(position, F.col("code")).alias("i"), F.col("title")))
    # four flag rows per key, so the collected array is bounded
    flat = flags.groupBy(*PANEL_KEY).agg(F.sort_array(F.collect_list(entry)).alias("on"))
    names = F.array_join(F.transform("on", lambda x: x["title"]), "; ")
    n = F.size("on")
    head, rest = FLAGS_TEXT.split("{n}")
    mid, tail = rest.split("{names}")
    text = F.concat(F.lit(head), n.cast("string"), F.lit(mid), names, F.lit(tail))
    return flat.select(
        *PANEL_KEY,
        n.alias("active_flags"),
        names.alias("titles"),
        F.when(n == 0, NO_FLAGS_TEXT).otherwise(text).alias("conclusion"),
    )


def domain_assessments(flags: DataFrame) -> DataFrame:
    """Six domain rows per (year, municipality): one with evidence, five without data."""
    per_key = flags.groupBy(*PANEL_KEY).agg(
        F.count_if("active").alias("active"),
        F.count_if(F.col("active") & F.col("code").isin(*STRONG_FLAGS)).alias("strong"),
    )
    fiscal_status = F.when(F.col("active") > 0, "SCREENING_SIGNAL").otherwise("CONTEXT")
    fiscal_evidence = F.when(F.col("strong") >= 2, "MEDIUM").otherwise("LOW")
    rows = F.array(
        *[
            F.struct(
                F.lit(d).alias("domain"),
                (fiscal_status if d == FISCAL_DOMAIN else F.lit("NO_DATA")).alias("status"),
                (fiscal_evidence if d == FISCAL_DOMAIN else F.lit("INSUFFICIENT")).alias("evidence"),
            )
            for d in DOMAINS
        ]
    )
    return per_key.select(*PANEL_KEY, F.inline(rows))


def plan_against_fact(plan: DataFrame, core: DataFrame) -> DataFrame:
    """Planned revenue and spending of a year against the fact of the year before, in percent."""
    fact = core.select(
        "municipality_name",
        (F.col("year") + 1).alias("year"),
        (F.col("tax_actual") + F.col("nontax_actual")).alias("fact_revenue"),
        F.col("total_expense").alias("fact_expenditure"),
    )
    joined = plan.join(fact, ["municipality_name", "year"])
    return joined.select(
        "municipality_name",
        "year",
        F.col("revenue_base").alias("planned_revenue"),
        "fact_revenue",
        ((safe_ratio("revenue_base", "fact_revenue") - 1.0) * 100.0).alias("revenue_change_pct"),
        F.col("expenditure").alias("planned_expenditure"),
        "fact_expenditure",
        ((safe_ratio("expenditure", "fact_expenditure") - 1.0) * 100.0).alias("expenditure_change_pct"),
    )
