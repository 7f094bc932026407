"""Pieces of SQL shared by the twins."""

from __future__ import annotations

from inplay.functions.hashing import poisson_sql, uniform_sql
from inplay.operators.bootstrap import BUCKETS, SEED
from inplay.plans.registry import ROLE_SQL

N_BOOT = 1000


def boot_ctes(stats: str, groups: list[str], sums: list[str], n_boot: int = N_BOOT, by: str = "game_id",
              prefix: str = "", seed: int = SEED, method: str = "poisson") -> str:
    """CTEs ending in {prefix}reps(groups, rep, sums): resampled entity sums of table `stats`."""
    g = "".join(f"{c}, " for c in groups)
    part = f"PARTITION BY {', '.join(groups)} " if groups else ""
    order = f"{by} % {BUCKETS}, {by}"
    weighted = ", ".join(f"sum({s} * w) AS {s}" for s in sums)
    if method == "poisson":
        w = poisson_sql(uniform_sql(seed, by, "rep"))
        return f"""{prefix}reps AS (SELECT {g}rep, {weighted} FROM (
            SELECT s.*, rep, {w} AS w FROM {stats} s, range({n_boot}) r(rep)) WHERE w > 0 GROUP BY {g}rep)"""
    using = ", ".join([*groups, "i"])
    return f"""{prefix}num AS (SELECT *, row_number() OVER ({part}ORDER BY {order}) AS i,
            count(*) OVER ({part.strip()}) AS g FROM {stats}),
        {prefix}draws AS (SELECT {g}rep, CAST(floor({uniform_sql(seed, 'i', 'rep')} * g) AS BIGINT) + 1 AS i, count(*) AS w
            FROM {prefix}num, range({n_boot}) r(rep) GROUP BY ALL),
        {prefix}reps AS (SELECT {g}rep, {weighted} FROM {prefix}draws JOIN {prefix}num USING ({using}) GROUP BY {g}rep)"""


def weight_ctes(games: str, n_boot: int = N_BOOT, by: str = "game_id", seed: int = SEED) -> str:
    """CTE wt(rep, game_id, w) of the drawn rows of table `games`."""
    return f"""wt AS (SELECT rep, {by}, w FROM (SELECT {by}, rep, {poisson_sql(uniform_sql(seed, by, 'rep'))} AS w FROM {games}, range({n_boot}) r(rep)) WHERE w > 0)"""


def q05(x: str) -> str:
    return f"quantile_cont({x}, 0.05)"


def q95(x: str) -> str:
    return f"quantile_cont({x}, 0.95)"


def brier(p: str, y: str = "y") -> str:
    return f"(({p}) - ({y})) * (({p}) - ({y}))"


def log_loss(p: str, y: str = "y", eps: str = "0.01") -> str:
    q = f"least(greatest({p}, {eps}::DOUBLE), 1 - {eps}::DOUBLE)"
    return f"-(({y}) * ln({q}) + (1 - ({y})) * ln(1 - {q}))"


def mc_var(p: str = "p_home") -> str:
    return f"CASE WHEN n_sims > 0 THEN greatest({p} * (1 - {p}) - 0.25::DOUBLE * p_tie, 0) / n_sims ELSE 0 END"


def asof_tables(d: int, source: str = "prices", tag: str = "") -> None:
    """Roles known{tag}{d}, quotes{tag}{d}, held{d}: the log as known with a delay of d seconds."""
    ROLE_SQL[f"known{tag}{d}"] = f"""SELECT *, max(t + CASE WHEN kind = 'pregame' THEN 0 ELSE {d}000000 END) OVER
        (PARTITION BY game_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS t_known FROM {source}"""
    ROLE_SQL[f"quotes{tag}{d}"] = f"""SELECT * FROM known{tag}{d}
        QUALIFY row_number() OVER (PARTITION BY game_id, t_known ORDER BY ord DESC) = 1"""
    if not tag:
        ROLE_SQL[f"held{d}"] = f"""SELECT game_id, t_play_end AS start, max(t + {d}000000) AS stop FROM prices
            WHERE timing = 'review' GROUP BY game_id, t_play_end"""
        ROLE_SQL[f"calm{d}"] = f"""SELECT g.* FROM in_game g ASOF LEFT JOIN held{d} h
            ON g.game_id = h.game_id AND g.t >= h.start WHERE h.stop IS NULL OR g.t >= h.stop"""
        ROLE_SQL[f"grid{d}"] = f"""SELECT *, {mc_var('model')} AS var_mc FROM (
            SELECT g.game_id, g.t, g.market, g.spread, g.kickoff, g.t_final, g.y, g.final_margin, g.final_total,
            q.t_known, q.ord, q.p_home AS model, q.p_tie, q.kind AS event_kind, q.qtr, q.game_seconds_remaining,
            q.n_sims, q.wp_direct_home
            FROM calm{d} g ASOF LEFT JOIN quotes{d} q ON g.game_id = q.game_id AND g.t >= q.t_known
            WHERE g.spread <= 0.05::DOUBLE + 1e-9)"""


ROLE_SQL.update({
    "spans": """SELECT game_id, kickoff, t_final, CASE WHEN h > a THEN 1.0 WHEN h < a THEN 0.0 ELSE 0.5 END::DOUBLE AS y,
        h - a AS final_margin, h + a AS final_total FROM (SELECT game_id,
        max(CASE WHEN kind = 'pregame' THEN t END) AS kickoff, max(CASE WHEN kind = 'final' THEN t END) AS t_final,
        max(CASE WHEN kind = 'final' THEN home_score END) AS h, max(CASE WHEN kind = 'final' THEN away_score END) AS a
        FROM prices GROUP BY game_id) WHERE kickoff IS NOT NULL AND t_final IS NOT NULL""",
    "in_game": """SELECT m.*, s.kickoff, s.t_final, s.y, s.final_margin, s.final_total FROM minutes m JOIN spans s
        USING (game_id) WHERE t >= kickoff AND t < t_final AND market IS NOT NULL""",
})
for _d in (0, 5, 10, 20):
    asof_tables(_d)

STAGE = """CASE WHEN qtr >= 5 THEN 'overtime' WHEN game_seconds_remaining <= 300 THEN 'last 5 min' ELSE 'Q' || qtr END"""


def pair_stats(source: str, groups: list[str], model: str = "model", var: str = "var_mc") -> str:
    g = "".join(f"{c}, " for c in groups)
    return f"""SELECT {g}game_id, count(*)::DOUBLE AS n, sum({brier(model)}) AS b_mod, sum({brier(model)} - {var}) AS b_cor,
        sum({brier('market')}) AS b_mkt, sum({log_loss(model)}) AS l_mod, sum({log_loss('market')}) AS l_mkt
        FROM {source} GROUP BY {g}game_id"""


PAIR_SUMS = ["n", "b_mod", "b_cor", "b_mkt", "l_mod", "l_mkt"]


def paired_sql(source: str, groups: list[str], model: str = "model", var: str = "var_mc", n_boot: int = N_BOOT) -> str:
    """A full statement: paired scores of `source` per group, with intervals."""
    g = "".join(f"{c}, " for c in groups)
    by = f"GROUP BY {', '.join(groups)}" if groups else ""
    join = f"JOIN band USING ({', '.join(groups)})" if groups else ", band"
    diffs = {"brier_diff": ("b_mod", "b_mkt"), "brier_corrected_diff": ("b_cor", "b_mkt"),
             "log_loss_diff": ("l_mod", "l_mkt")}
    bands = ", ".join(f"{q(f'({a} - {b}) / n')} AS {k}_{t}" for k, (a, b) in diffs.items()
                      for t, q in (("p05", q05), ("p95", q95)))
    rounded = ", ".join(f"round({c}, 6) AS {c}" for c in [
        "brier_model", "brier_model_corrected", "brier_market", "log_loss_model", "log_loss_market", *diffs,
        *[f"{k}_{t}" for k in diffs for t in ("p05", "p95")]])
    return f"""WITH st AS ({pair_stats(source, groups, model, var)}),
        {boot_ctes('st', groups, PAIR_SUMS, n_boot)},
        total AS (SELECT {g}sum(n)::BIGINT AS rows, count(*) AS games, sum(b_mod)/sum(n) AS brier_model,
          sum(b_cor)/sum(n) AS brier_model_corrected, sum(b_mkt)/sum(n) AS brier_market, sum(l_mod)/sum(n) AS log_loss_model,
          sum(l_mkt)/sum(n) AS log_loss_market, (sum(b_mod)-sum(b_mkt))/sum(n) AS brier_diff,
          (sum(b_cor)-sum(b_mkt))/sum(n) AS brier_corrected_diff, (sum(l_mod)-sum(l_mkt))/sum(n) AS log_loss_diff
          FROM st {by}),
        band AS (SELECT {g}{bands} FROM reps {by})
        SELECT {g}rows, games, {rounded} FROM total {join}"""


def interval_sql(source: str, value: str, groups: list[str], weight: str = "1.0::DOUBLE", n_boot: int = N_BOOT,
                 prefix: str = "") -> str:
    """CTEs ending in {prefix}iv(groups, mean, p05, p95, rows, games)."""
    g = "".join(f"{c}, " for c in groups)
    by = f"GROUP BY {', '.join(groups)}" if groups else ""
    join = f"JOIN {prefix}bd USING ({', '.join(groups)})" if groups else f", {prefix}bd"
    return f"""{prefix}ist AS (SELECT {g}game_id, sum({weight}) AS sw, sum(({weight}) * ({value})) AS sx, count(*) AS n
          FROM {source} GROUP BY {g}game_id),
        {boot_ctes(f'{prefix}ist', groups, ['sw', 'sx'], n_boot, prefix=prefix)},
        {prefix}tot AS (SELECT {g}sum(sx)/sum(sw) AS mean, sum(n)::BIGINT AS rows, count(*) AS games FROM {prefix}ist {by}),
        {prefix}bd AS (SELECT {g}{q05('sx/sw')} AS p05, {q95('sx/sw')} AS p95 FROM {prefix}reps {by}),
        {prefix}iv AS (SELECT * FROM {prefix}tot {join})"""


def cols6(names: list[str]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in names)
