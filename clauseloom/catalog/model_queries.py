"""Tasks, prompts, responses and summaries over all contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseloom.catalog import ctes as C
from clauseloom.catalog import fixture
from clauseloom.catalog.registry import query
from clauseloom.operators import display, metrics, prompts, sketches, summary
from clauseloom.operators.clauses import find_clauses
from clauseloom.sources.stages import stage
from clauseloom.taxonomy import CLAUSE_NAMES

_MENTIONED = " + ".join(
    f"CAST({k}_clause IS NOT NULL AND {C.mentions('summary', k)} AS INTEGER)" for k in C.PATTERNS
)
_TYPES = " + ".join(f"CAST({k}_clause IS NOT NULL AS INTEGER)" for k in C.PATTERNS)


def _results(spark, sf_dir):
    contracts = fixture.stored_contracts(spark, sf_dir)
    return prompts.task_results(prompts.tasks(contracts), fixture.responses(contracts))


@query("tasks", C.sql("SELECT contract_id, task, max_tokens, temperature FROM tasks", "tasks"))
def _(spark, sf_dir):
    return prompts.tasks(fixture.contracts(spark, sf_dir).select("contract_id"))


@query(
    "clause_prompts",
    C.sql(
        "SELECT contract_id, task, system, md5(prompt) AS prompt_md5 FROM prompts WHERE task <> 'summary'", "prompts"
    ),
)
def _(spark, sf_dir):
    rows = prompts.prompts(fixture.contracts(spark, sf_dir), names=CLAUSE_NAMES)
    return rows.select("contract_id", "task", "system", F.md5("prompt").alias("prompt_md5"))


@query(
    "summary_prompts",
    C.sql("SELECT contract_id, system, prompt FROM prompts WHERE task = 'summary'", "prompts"),
)
def _(spark, sf_dir):
    rows = prompts.prompts(fixture.contracts(spark, sf_dir), names=["summary"])
    return rows.select("contract_id", "system", "prompt")


@query(
    "prompt_tokens",
    C.sql(
        "SELECT contract_id, task, CAST(ceil(length(prompt) / 4.0) AS INTEGER) AS tokens FROM prompts", "prompts"
    ),
)
def _(spark, sf_dir):
    return prompts.prompts(fixture.contracts(spark, sf_dir)).select("contract_id", "task", "tokens")


@query(
    "token_efficiency",
    C.sql(
        """SELECT task, CAST(sum(tokens) AS BIGINT) AS tokens, count(DISTINCT contract_id) AS contracts,
        round(sum(tokens) / count(DISTINCT contract_id), 6) AS mean_tokens
        FROM (SELECT contract_id, task, ceil(length(prompt) / 4.0) AS tokens FROM prompts
              UNION ALL SELECT contract_id, 'all', ceil(length(prompt) / 4.0) FROM prompts) GROUP BY task""",
        "prompts",
    ),
)
def _(spark, sf_dir):
    return metrics.token_efficiency(prompts.prompts(fixture.contracts(spark, sf_dir)))


@query("task_results", C.sql("SELECT contract_id, task, status, value, shown FROM results", "results"))
def _(spark, sf_dir):
    return _results(spark, sf_dir)


@query(
    "wide_results",
    C.sql(
        """SELECT contract_id, max(CASE WHEN task = 'termination' THEN shown END) AS termination_clause,
        max(CASE WHEN task = 'confidentiality' THEN shown END) AS confidentiality_clause,
        max(CASE WHEN task = 'liability' THEN shown END) AS liability_clause,
        max(CASE WHEN task = 'summary' THEN shown END) AS summary FROM results GROUP BY contract_id""",
        "results",
    ),
)
def _(spark, sf_dir):
    return prompts.wide_results(_results(spark, sf_dir))


@query(
    "contract_lines",
    C.sql(
        """SELECT contract_id,
        substring(max(CASE WHEN task = 'summary' THEN shown END), 1, 100) || '...' AS summary,
        substring(max(CASE WHEN task = 'termination' THEN shown END), 1, 100) || '...' AS termination_clause
        FROM results GROUP BY contract_id ORDER BY contract_id LIMIT 2""",
        "results",
    ),
)
def _(spark, sf_dir):
    return display.contract_lines(prompts.wide_results(_results(spark, sf_dir)))


@query(
    "pending_tasks",
    C.sql(
        """SELECT contract_id, task, CAST(coalesce(attempt, 0) + 1 AS INTEGER) AS attempt
        FROM tasks LEFT JOIN responses USING (contract_id, task)
        WHERE coalesce(status, 'error') = 'error' AND coalesce(attempt, 0) < 3""",
        "tasks",
        "responses",
    ),
)
def _(spark, sf_dir):
    contracts = fixture.stored_contracts(spark, sf_dir)
    return prompts.pending_tasks(prompts.tasks(contracts.select("contract_id")), fixture.responses(contracts))


@query(
    "success_rate",
    C.sql(
        """SELECT count(*) AS contracts, count(*) FILTER (ok) AS succeeded,
        round(count(*) FILTER (ok) / count(*), 6) AS rate
        FROM (SELECT contract_id, bool_and(status <> 'error') AS ok FROM results GROUP BY contract_id)""",
        "results",
    ),
)
def _(spark, sf_dir):
    return metrics.success_rate(_results(spark, sf_dir))


@query("summaries", C.sql("SELECT contract_id, summary, words FROM summaries", "summaries"))
def _(spark, sf_dir):
    return summary.summarize(fixture.contracts_by_key(spark, sf_dir))


@query(
    "summary_lengths",
    C.sql(
        f"""SELECT contract_id, {C.words('summary')} AS words, {C.words('summary')} BETWEEN 100 AND 150 AS in_range
        FROM summaries""",
        "summaries",
    ),
)
def _(spark, sf_dir):
    return summary.length_check(summary.summarize(fixture.contracts_by_key(spark, sf_dir))).select(
        "contract_id", "words", "in_range"
    )


@query(
    "summary_quality",
    C.sql(
        """SELECT count(*) AS summaries,
        round(avg(CAST(words BETWEEN 100 AND 150 AS DOUBLE)), 6) AS in_range_share, round(avg(words), 6) AS mean_words
        FROM summaries""",
        "summaries",
    ),
)
def _(spark, sf_dir):
    return metrics.summary_quality(summary.length_check(summary.summarize(fixture.contracts_by_key(spark, sf_dir))))


@query(
    "summary_completeness",
    C.sql(
        f"""SELECT contract_id, {_TYPES} AS types_found, {_MENTIONED} AS types_mentioned,
        round(({_MENTIONED}) / nullif({_TYPES}, 0), 6) AS completeness
        FROM summaries JOIN wide USING (contract_id)""",
        "summaries",
        "wide",
    ),
)
def _(spark, sf_dir):
    contracts = fixture.contracts_by_key(spark, sf_dir)
    scores = summary.completeness(summary.summarize(contracts), find_clauses(contracts))
    return scores.withColumn("completeness", F.round("completeness", 6))


@query(
    "processing_rate",
    """SELECT count(*) AS rows, round(epoch_us(max(ts) - min(ts)) / 1e6, 6) AS seconds,
    round(count(*) * 60.0 / (epoch_us(max(ts) - min(ts)) / 1e6), 6) AS per_minute,
    round((epoch_us(max(ts) - min(ts)) / 1e6) / count(*), 6) AS seconds_per_row FROM events""",
)
def _(spark, sf_dir):
    return metrics.processing_rate(fixture.table(spark, sf_dir, "events"), "ts")


@query(
    "rate_per_hour",
    """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS rows
    FROM events GROUP BY 1""",
)
def _(spark, sf_dir):
    rates = metrics.windowed_rate(fixture.table(spark, sf_dir, "events"), "ts", "1 hour")
    return rates.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "rows")


@query(
    "rate_per_minute",
    """SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS rows
    FROM events GROUP BY 1""",
)
def _(spark, sf_dir):
    rates = metrics.windowed_rate(fixture.table(spark, sf_dir, "events"), "ts")
    return rates.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "rows")


@query(
    "rate_sliding",
    """SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS rows FROM (
      SELECT date_trunc('minute', ts) - to_minutes(CAST(unnest(range(5)) AS INTEGER)) AS start FROM events)
    GROUP BY 1""",
)
def _(spark, sf_dir):
    rates = metrics.windowed_rate(fixture.table(spark, sf_dir, "events"), "ts", "5 minutes", "1 minute")
    return rates.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "rows")


@query(
    "merged_sketches",
    """SELECT event_type, count(*) AS rows, count(DISTINCT user_id) AS users, true AS users_near,
      true AS median_near, true AS p90_near FROM events GROUP BY event_type""",
)
def _(spark, sf_dir):
    """Sketches per event type and day are stored, then merged per type and held against the exact figures."""
    events = fixture.table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    amount = F.round(F.col("value") * 100)
    stored = stage(sketches.sketch(events, ["event_type", "day"], F.col("user_id"), amount), "sketches")
    merged = sketches.read(sketches.merge(stored, ["event_type"])).withColumnRenamed("rows", "merged_rows")
    measured = events.join(merged, "event_type")
    below = [F.avg((amount <= F.col("quantiles")[n]).cast("double")) for n in (0, 1)]
    under = [F.avg((amount < F.col("quantiles")[n]).cast("double")) for n in (0, 1)]
    exact = measured.groupBy("event_type").agg(
        F.first("merged_rows").alias("rows"), F.count_distinct("user_id").alias("users"),
        F.first("distinct").alias("estimate"), *[b.alias(f"below{n}") for n, b in enumerate(below)],
        *[u.alias(f"under{n}") for n, u in enumerate(under)],
    )
    # Three standard errors of the distinct count, twice the stated rank error of the quantiles.
    near = [(F.col(f"below{n}") >= r - 0.03) & (F.col(f"under{n}") <= r + 0.03) for n, r in enumerate((0.5, 0.9))]
    return exact.select(
        "event_type", "rows", "users",
        (F.abs(F.col("estimate") - F.col("users")) <= F.greatest(F.lit(1.0), F.col("users") * 0.05)).alias("users_near"),
        near[0].alias("median_near"), near[1].alias("p90_near"),
    )
