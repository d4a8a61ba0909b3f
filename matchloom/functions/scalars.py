"""Scalar rules as column expressions.

Every threshold is an argument with the production default, and every
reference time is an argument as well; nothing reads a clock.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strata of a player's trophies, lower bound included.
BRACKETS = ((0, "0-5k"), (5000, "5k-15k"), (15000, "15k-30k"), (30000, "30k-50k"), (50000, "50k-75k"), (75000, "75k+"))
UNRANKED = "unranked"
#: Tiers by the least percentile, best first.
TIERS = (("S", 90.0), ("A", 70.0), ("B", 30.0), ("C", 10.0))
LAST_TIER = "D"
#: The alphabet of player tags.
TAG_ALPHABET = "0289PYLQGRJCUV"


def win_rate(wins: Column, losses: Column) -> Column:
    """Wins over decided matches; null where none was decided."""
    return F.try_divide(wins.cast("double"), F.nullif(wins + losses, F.lit(0)))


def reconciles(matches: Column, wins: Column, losses: Column, draws: Column) -> Column:
    nonnegative = (matches >= 0) & (wins >= 0) & (losses >= 0) & (draws >= 0)
    return nonnegative & (wins + losses + draws <= matches)


def days_between(earlier: Column, later: Column) -> Column:
    """Fractional days."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86_400_000_000.0)


def recency_weight(days: Column, full: float = 30, half: float = 90, none: float = 180) -> Column:
    return (
        F.when(days <= full, F.lit(1.0))
        .when(days <= half, 1.0 - (days - full) / (half - full) * 0.5)
        .when(days <= none, 0.5 - (days - half) / (none - half) * 0.5)
        .otherwise(0.0)
    )


def version_blend_weight(current_rows: Column, scale: float = 100) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), current_rows.cast("double")) / scale)


def blend(current: Column, overall: Column, weight: Column) -> Column:
    """A weighted mean; a missing side leaves the other at full weight."""
    return F.coalesce(current * weight + overall * (1.0 - weight), current, overall)


def overall_score(
    win: Column, pick: Column, high: Column, coverage: Column, weights: tuple[float, ...] = (0.5, 0.2, 0.2, 0.1)
) -> Column:
    w = [F.lit(x) for x in weights]
    return (w[0] * win + w[1] * pick + w[2] * F.coalesce(high, win) + w[3] * F.coalesce(coverage, F.lit(0.5))) * 100


def mode_score(win: Column, pick: Column, weights: tuple[float, float] = (0.7, 0.3)) -> Column:
    return (win * weights[0] + pick * weights[1]) * 100


def tier(percentile: Column, tiers=TIERS) -> Column:
    out = F.when(percentile.isNull(), F.lit(None).cast("string"))
    for name, least in tiers:
        out = out.when(percentile >= least, name)
    return out.otherwise(LAST_TIER)


def high_gate(recent: Column, regions: Column, brackets: Column) -> Column:
    return recent & (regions >= 2) & (brackets >= 2)


def confidence(matches: Column, gate: Column, floors: tuple[int, int, int] = (100, 200, 500)) -> Column:
    """Labels by sample size; the highest needs the gate as well."""
    low, medium, high = floors
    return (
        F.when(matches < low, "insufficient").when(matches < medium, "low")
        .when((matches >= high) & gate, "high").otherwise("medium")
    )


def matchup_class(rate: Column, matches: Column, floor: int = 20, bands=(0.35, 0.45, 0.55, 0.65)) -> Column:
    a, b, c, d = bands
    return (
        F.when(rate.isNull() | (matches < floor), F.lit(None).cast("string"))
        .when(rate <= a, "hard_counter").when(rate < b, "counter").when(rate <= c, "neutral")
        .when(rate < d, "strong").otherwise("hard_advantage")
    )


def matchup_confidence(matches: Column, consistent: Column, floors=(20, 40, 100)) -> Column:
    low, probable, high = floors
    return (
        F.when(matches < low, "insufficient").when(matches < probable, "weak_signal")
        .when((matches >= high) & consistent, "high_confidence_counter").otherwise("probable_counter")
    )


def bracket(trophies: Column) -> Column:
    number = trophies.cast("double")
    out = F.when(number.isNull() | F.isnan(number) | (number < 0), UNRANKED)
    for (_, name), (upper, _) in zip(BRACKETS, BRACKETS[1:], strict=False):
        out = out.when(number < upper, name)
    return out.otherwise(BRACKETS[-1][1])


def clean_text(text: Column) -> Column:
    """Trimmed; blank is null."""
    return F.nullif(F.trim(text), F.lit(""))


def tag(raw: Column) -> Column:
    """Upper case with a leading #."""
    upper = F.upper(F.trim(raw))
    return F.when(upper.startswith("#"), upper).otherwise(F.concat(F.lit("#"), upper))


def tag_problem(raw: Column, least: int = 4, most: int = 16, alphabet: str = TAG_ALPHABET) -> Column:
    """Why a tag is not valid, or null."""
    t = tag(raw)
    return (
        F.when(clean_text(raw).isNull(), "empty")
        .when(F.length(t) < least, "too_short")
        .when(F.length(t) > most, "too_long")
        .when(~t.rlike(f"^#[{alphabet}]+$"), "invalid_characters")
    )


def tag_in_url(raw: Column) -> Column:
    """The first # percent-encoded."""
    return F.regexp_replace(tag(raw), "^#", "%23")


def country(raw: Column) -> Column:
    """Two letters in lower case, or ``global``; else null."""
    low = F.lower(F.trim(raw))
    return F.when((low == "global") | low.rlike("^[a-z]{2}$"), low)


def slug(name: Column) -> Column:
    """Lower case, accents folded, other characters to single dashes."""
    folded = F.translate(
        F.lower(name), "àáâãäåèéêëìíîïòóôõöùúûüçñýÿ", "aaaaaaeeeeiiiiooooouuuucnyy"
    )
    dashed = F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(dashed, F.lit("")), F.lit("unnamed"))


def failure_code(status: Column, transport: Column) -> Column:
    """What an HTTP status or a transport error means for a retry."""
    return (
        F.when(transport == "proxy_timeout", "timeout")
        .when(transport.isin("proxy_unreachable", "proxy_not_configured"), "proxy_unavailable")
        .when(transport == "invalid_json_response", "schema_mismatch")
        .when(status.isNull(), "network_failure")
        .when(status == 429, "rate_limited")
        .when(status.isin(401, 403), "unauthorized")
        .when(status == 404, "not_found")
        .when(status >= 500, "server_error")
        .otherwise("invalid_data")
    )


#: Attempts allowed for codes that may be retried; all others end as ``dead``.
RETRY_ATTEMPTS = {
    "timeout": 3, "network_failure": 3, "proxy_unavailable": 3, "rate_limited": 5, "server_error": 3,
    "transaction_failure": 3, "deadlock": 3, "lock_timeout": 3,
}


def retry_decision(code: Column, attempts: Column) -> Column:
    """``retry``, or how the work ends."""
    most = F.create_map(*[F.lit(x) for pair in RETRY_ATTEMPTS.items() for x in pair])
    allowed = F.try_element_at(most, code)
    return F.when(allowed.isNull(), "dead").when(attempts >= allowed, "failed").otherwise("retry")


def failure_delay_minutes(failures: Column, first: float = 10, most: float = 1440) -> Column:
    """Back-off before jitter: doubled with each failure, up to a day."""
    return F.least(F.lit(float(most)), first * F.pow(F.lit(2.0), F.greatest(failures - 1, F.lit(0)).cast("double")))


def request_delay_ms(attempt: Column, retry_after_s: Column, first: float = 2000, most: float = 300_000) -> Column:
    doubled = F.least(F.lit(float(most)), first * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0)).cast("double")))
    return F.when(retry_after_s > 0, F.least(F.lit(float(most)), retry_after_s * 1000.0)).otherwise(doubled)


def archive_delay_s(attempt: Column, first: float = 60, most: float = 3600) -> Column:
    return F.least(F.lit(float(most)), first * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0)).cast("double")))


def priority_after(score: Column, succeeded: Column, gain: float = 0.1, loss: float = 0.5, bound: float = 10) -> Column:
    return F.when(succeeded, F.least(F.lit(float(bound)), score + gain)).otherwise(
        F.greatest(F.lit(-float(bound)), score - loss)
    )


def match_key(time_raw: Column, mode: Column, teams: Column) -> Column:
    """Identity of a match that no order of teams or members changes."""
    keys = F.transform(
        teams, lambda t: F.array_join(F.array_sort(F.transform(t, lambda m: F.upper(F.trim(m)))), ",")
    )
    joined = F.array_join(F.array_sort(F.filter(keys, lambda k: k != "")), "|")
    return F.sha2(F.concat_ws("|", time_raw, mode, joined), 256)


def version_label(at: Column) -> Column:
    return F.concat(F.lit("internal-"), F.date_format(at, "yyyyMMdd'T'HHmmss"), F.lit("Z"))


def match_time(raw: Column) -> Column:
    """20260715T120000.000Z as a timestamp; null where it is none."""
    return F.try_to_timestamp(F.substring(raw, 1, 15), F.lit("yyyyMMdd'T'HHmmss"))


def success_delay_minutes(empty: Column, usual: float = 120, quiet: float = 720) -> Column:
    return F.when(empty, F.lit(float(quiet))).otherwise(float(usual))


def exceeds_guard(move_ratio: Column, first_run: Column, guard: float = 0.25) -> Column:
    """Whether too many tiers move at once; the first run of all is free."""
    return ~first_run & (move_ratio > guard)


def significant(old_tier: Column, tier: Column, old_score: Column, score: Column, least: float = 1.0) -> Column:
    """A new entry, another tier, or a score that moved by more than ``least``."""
    return old_tier.isNull() | (old_tier != tier) | (F.abs(score - old_score) > least)


def upstream_status(body: Column) -> Column:
    """The status that a gateway's error body wraps, or null where the error is its own."""
    wrapped = F.get_json_object(body, "$.error") == "upstream_api_error"
    return F.when(wrapped, F.get_json_object(body, "$.upstreamStatus").try_cast("int"))
