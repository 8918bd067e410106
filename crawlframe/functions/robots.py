"""robots.txt rules as column expressions over (site, robots_txt) rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlframe.functions.lang import let, strip

_RULES = "array<struct<allow:boolean,path:string>>"
_GROUPS = f"array<struct<agents:array<string>,rules:{_RULES}>>"


def _percent_decode(text: Column) -> Column:
    safe = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(safe), text)


def canonical_path(path: Column) -> Column:
    """Percent-decode, then percent-encode everything but unreserved characters and '/'."""
    out = F.url_encode(_percent_decode(path))
    for old, new in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%7E", "~")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def request_target(url: Column) -> Column:
    """Canonical path and query of an absolute URL, '/' if empty."""
    target = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", "")
    return F.coalesce(F.nullif(canonical_path(target), F.lit("")), F.lit("/"))


def _directive(line: Column) -> Column:
    text = strip(F.regexp_replace(line, "#.*$", ""))
    field = F.lower(strip(F.regexp_extract(text, "^([^:]*):", 1)))
    value = strip(F.regexp_replace(text, "^[^:]*:", ""))
    kind = (
        F.when(line == "", F.lit("blank"))
        .when(field == "user-agent", F.lit("agent"))
        .when(field.isin("allow", "disallow"), F.lit("rule"))
        .when(field.isin("crawl-delay", "request-rate"), F.lit("delay"))
        .otherwise(F.lit("other"))
    )
    path = F.regexp_replace(value, r"([^?#])[?#]$", "$1")
    return F.struct(
        kind.alias("kind"),
        value.alias("value"),
        ((field == "allow") | (value == "")).alias("allow"),
        canonical_path(path).alias("path"),
    )


def _groups(robots_txt: Column) -> Column:
    """Fold the lines into user-agent groups."""
    lines = F.transform(F.split(F.regexp_replace(robots_txt, r"\r\n?", "\n"), "\n", -1), _directive)
    no_agents = F.lit([]).cast("array<string>")
    no_rules = F.from_json(F.lit("[]"), _RULES)
    start = F.struct(
        F.lit(0).alias("phase"),
        no_agents.alias("agents"),
        no_rules.alias("rules"),
        F.from_json(F.lit("[]"), _GROUPS).alias("groups"),
    )

    def closed(acc: Column) -> Column:
        group = F.struct(acc["agents"].alias("agents"), acc["rules"].alias("rules"))
        return F.when(acc["phase"] == 2, F.concat(acc["groups"], F.array(group))).otherwise(acc["groups"])

    def state(phase, agents, rules, groups) -> Column:
        return F.struct(
            phase.alias("phase"), agents.alias("agents"), rules.alias("rules"), groups.alias("groups")
        )

    def step(acc: Column, d: Column) -> Column:
        rule = F.struct(d["allow"].alias("allow"), d["path"].alias("path"))
        fresh = F.when(acc["phase"] == 2, no_agents).otherwise(acc["agents"])
        return (
            F.when((d["kind"] == "blank") & (acc["phase"] > 0),
                   state(F.lit(0), no_agents, no_rules, closed(acc)))
            .when(d["kind"] == "agent",
                  state(F.lit(1), F.concat(fresh, F.array(d["value"])),
                        F.when(acc["phase"] == 2, no_rules).otherwise(acc["rules"]), closed(acc)))
            .when((d["kind"] == "rule") & (acc["phase"] > 0),
                  state(F.lit(2), acc["agents"], F.concat(acc["rules"], F.array(rule)), acc["groups"]))
            .when((d["kind"] == "delay") & (acc["phase"] > 0),
                  state(F.lit(2), acc["agents"], acc["rules"], acc["groups"]))
            .otherwise(acc)
        )

    return F.aggregate(lines, start, step, closed)


def rules_for(robots_txt: Column, agent: str) -> Column:
    """Ordered rules that bind one crawler: its own group if named, else the '*' group."""
    token = F.lit(agent.split("/")[0].lower())

    def pick(groups: Column) -> Column:
        named = F.filter(
            groups,
            lambda g: ~F.array_contains(g["agents"], "*")
            & F.exists(g["agents"], lambda a: F.contains(token, F.lower(a))),
        )
        anyone = F.filter(groups, lambda g: F.array_contains(g["agents"], "*"))
        return F.coalesce(F.get(named, F.lit(0))["rules"], F.get(anyone, F.lit(0))["rules"])

    return F.coalesce(let(_groups(robots_txt), pick), F.from_json(F.lit("[]"), _RULES))


def allowed_by(rules: Column, target: Column) -> Column:
    """Verdict of the first rule whose path is a prefix of the target; allowed if none is."""
    first = F.get(F.filter(rules, lambda r: F.startswith(target, r["path"])), F.lit(0))
    return F.coalesce(first["allow"], F.lit(True))
