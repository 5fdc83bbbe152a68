"""Decisions over distributions and limits, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(weights: Column) -> Column:
    """A map of weights as shares of their sum; null where the sum isn't positive."""
    total = F.aggregate(F.map_values(weights), F.lit(0.0), lambda a, x: a + F.greatest(x, F.lit(0.0)))
    return F.when(total > 0, F.transform_values(weights, lambda _, x: F.greatest(x, F.lit(0.0)) / total))


def confidence(shares: Column, n_options: Column) -> Column:
    """1 - entropy / ln(options), within 0 and 1; 1 for a single option."""
    entropy = F.aggregate(F.map_values(shares), F.lit(0.0), lambda a, p: a + F.when(p > 0, -p * F.ln(p)).otherwise(0.0))
    return F.when(n_options <= 1, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - entropy / F.ln(n_options.cast("double")))))


def softmax(logs: Column) -> Column:
    """A map of arrays of log probabilities, summed per option, as shares; the greatest is taken out first."""
    most = F.array_max(F.flatten(F.map_values(logs)))
    return normalized(F.transform_values(logs, lambda _, xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.exp(x - most))))


def choice(shares: Column, options: Column) -> Column:
    """The option with the greatest share, the earliest of equals; null without options."""
    ranked = F.transform(options, lambda o, i: F.struct(F.coalesce(F.try_element_at(shares, o), F.lit(0.0)).alias("p"), (-i).alias("i"), o.alias("o")))
    return F.array_max(ranked)["o"]


def expected_level(shares: Column, levels: Column) -> Column:
    """The mean of the levels' places, counted from 0, by their shares."""
    parts = F.transform(levels, lambda o, i: F.coalesce(F.try_element_at(shares, o), F.lit(0.0)) * i)
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def budget_state(used: Column, limit: Column, warn: float = 0.8) -> Column:
    """ok, warn or exhausted by used / limit; a limit below 0 is none."""
    share = F.try_divide(used.cast("double"), limit.cast("double"))
    return F.when(limit < 0, "unlimited").when(share.isNull() | (share >= 1), "exhausted").when(share >= warn, "warn").otherwise("ok")


def gate(run: dict[str, Column], evidence: dict[str, Column], escalate_after: int = 2, low_confidence: float = 0.5) -> Column:
    """What a run does next (action and reason), the first of nine cases that holds.

    run: budget (a state as of budget_state), failures in a row, iterations, max_iterations (0: none), tier of its model
    and can_rise (a stronger model is allowed). evidence, each of which may be null: validation (pass or fail), exit_code
    of tests, critical, architectural, confidence. A failing exit code fails; a passing one passes unless the
    validation failed. Where no stronger model is allowed, a person is asked instead.
    """
    verdict, code = evidence["validation"], evidence["exit_code"]
    failed = F.coalesce(verdict == "fail", F.lit(False)) | F.coalesce(code != 0, F.lit(False))
    passed = F.coalesce(verdict == "pass", F.lit(False)) | (F.coalesce(code == 0, F.lit(False)) & F.coalesce(verdict != "fail", F.lit(True)))
    failures = run["failures"] + failed.cast("int")
    yes = lambda c: F.coalesce(c, F.lit(False))
    says = lambda action, reason: F.struct(F.lit(action).alias("action") if isinstance(action, str) else action.alias("action"), F.lit(reason).alias("reason"))
    rise = F.when(run["can_rise"], "escalate").otherwise("ask_human")
    return (
        F.when(run["budget"] == "exhausted", says("fail", "budget"))
        .when(passed, says("done", "passed"))
        .when((run["max_iterations"] > 0) & (run["iterations"] + 1 >= run["max_iterations"]) & failed, says("fail", "iterations"))
        .when(failed & (failures >= escalate_after), says(rise, "failures"))
        .when(yes(evidence["critical"]) & (run["tier"] < 5), says(rise, "critical"))
        .when(yes(evidence["architectural"]) & (run["tier"] < 4), says(rise, "architecture"))
        .when(yes(evidence["confidence"] < low_confidence), says(rise, "confidence"))
        .when(failed, says("repair", "validation"))
        .otherwise(says("done", "no evidence"))
    )


# Tools and their categories, the first pattern that fits; * stands for anything.
TOOLS = [
    ("terminal", "shell"), ("execute_code", "shell"), ("process_manage", "shell"), ("read_file", "filesystem"), ("write_file", "filesystem"), ("patch", "filesystem"),
    ("search_files", "filesystem"), ("web_search", "web_research"), ("web_extract", "web_research"), ("browser_*", "web_research"), ("delegate_task", "delegate"), ("kanban_*", "tasks"),
    ("cronjob_manage", "tasks"), ("send_message", "messaging"), ("mcp__knowledge__*", "knowledge"), ("mcp__*", "mcp"),
]
# Patterns of paths and commands that nobody may use.
SECRET_PATH = (
    r"(?i)(^|/)(\.env(\.(?!example$|sample$|template$)[\w-]+)?|[^/]*\.pem|id_(rsa|ed25519|ecdsa)(\.pub)?|"
    r"secrets?\.(ya?ml|json|toml|env|txt)|\.ssh/[^/]+|\.netrc|\.git-credentials|credentials\.json)$"
)
SECRET_IN_COMMAND = r"(?i)(^|[\s'\x22=/<])(\.env(?!\.(example|sample|template)\b)\b|[\w./-]*\.pem\b|id_(rsa|ed25519|ecdsa)\b|\.ssh/|\.git-credentials|\.netrc)"
DESTRUCTIVE = [
    r"(?i)\brm\s+(-[a-z]*r[a-z]*f|-[a-z]*f[a-z]*r)[a-z]*\s+(/|~|\$HOME|\*)(\s|$)", r"(?i)\bgit\s+push\b[^\n]*(--force\b|-f\b)[^\n]*\b(main|master)\b",
    r"(?i)\b(drop\s+(database|schema)|truncate\s+table)\b", r"(?i)\bmkfs(\.\w+)?\b|\bdd\s+[^\n]*of=/dev/", r":\(\)\s*\{\s*:\|:&\s*\};:", r"(?i)\bcurl\b[^\n|]*\|\s*(sudo\s+)?(ba)?sh\b",
]


def tool_category(tool: Column) -> Column:
    """The category of a tool; null for one that belongs to none."""
    out = F.lit(None).cast("string")
    for pattern, category in reversed(TOOLS):
        out = F.when(tool.rlike("^" + re.escape(pattern).replace(r"\*", ".*") + "$"), category).otherwise(out)
    return out


def tool_verdict(call: dict[str, Column], agent: dict[str, Column], session_tenant: Column) -> Column:
    """May an agent call a tool? allow and the reason, the first case that holds.

    call: tool, paths (array), command, tenant, domain. agent: known (false: core rules only), tools, tenants, deny_domains
    (arrays; no tenants means all). The tenant "shared" is open to every agent.
    """
    no = lambda reason: F.struct(F.lit(False).alias("allow"), F.lit(reason).alias("reason"))
    holds = lambda c: F.coalesce(c, F.lit(False))
    paths = F.coalesce(call["paths"], F.array().cast("array<string>"))
    command, tenant, category = F.coalesce(call["command"], F.lit("")), F.nullif(call["tenant"], F.lit("")), tool_category(call["tool"])
    destructive = F.lit(False)
    for pattern in DESTRUCTIVE:
        destructive = destructive | command.rlike(pattern)
    known = holds(agent["known"])
    # What isn't surely allowed is denied: null lists and lists with nulls allow no more than they name.
    listed = lambda values, x: holds(F.array_contains(values, x))
    outside = ~(listed(agent["tools"], category) | listed(agent["tools"], "*"))
    return (
        F.when(holds(F.exists(paths, lambda p: F.replace(p, F.lit("\\"), F.lit("/")).rlike(SECRET_PATH))), no("secret path"))
        .when(command.rlike(SECRET_IN_COMMAND), no("secret in command"))
        .when(destructive, no("destructive"))
        .when(known & category.isNotNull() & outside, no("category"))
        .when(known & holds((tenant != "shared") & (F.size(agent["tenants"]) > 0) & ~listed(agent["tenants"], tenant)), no("tenant"))
        .when(known & holds(session_tenant.isNotNull() & (session_tenant != "") & (tenant != session_tenant) & (tenant != "shared")), no("session"))
        .when(known & holds(F.array_contains(agent["deny_domains"], call["domain"])), no("domain"))
        .otherwise(F.struct(F.lit(True).alias("allow"), F.lit("").alias("reason")))
    )


def permission(effects: Column) -> Column:
    """Deny over ask over allow; deny where nothing is said."""
    return F.when(F.array_contains(effects, "deny"), "deny").when(F.array_contains(effects, "ask"), "ask").when(F.array_contains(effects, "allow"), "allow").otherwise("deny")


def first_match(text: Column, patterns: list[tuple[str, str]], other: str) -> Column:
    """The answer of the first pattern that matches."""
    out = F.lit(None).cast("string")
    for pattern, answer in reversed(patterns):
        out = F.when(text.rlike(pattern), answer).otherwise(out)
    return F.coalesce(out, F.lit(other))


def problems(checks: list[tuple[Column, str]]) -> Column:
    """The messages of the checks that fail, in order; a null check fails too."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(message)) for ok, message in checks]))
