"""Rules over command lines: which of them are risky, how often, and whether they worked."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import all_of, any_of, pct


@dataclass(frozen=True)
class Rule:
    """All ``patterns`` must match the line, whose program is in lower case and without its folder, or any of ``anywhere`` the line as it stands; ``{name}`` stands for a variable."""

    severity: str
    patterns: tuple[str, ...]
    anywhere: tuple[str, ...] = ()


CLUSTER = r"holy|bos|node|gpu|c\d{3,}"  # fixed value: how compute nodes' names begin, where no other is given

DEFAULTS = {
    "nvidia_smi": Rule("low", (r"^nvidia-smi( |$)",)),
    "nvcc": Rule("low", (r"^nvcc( |$)",)),
    "pip_install": Rule("med", (r"^(pip|pip3|pip3\.[0-9]+|python[0-9.]*( -[A-Za-z]+)* -m pip)( |$)", r" install( |$)")),
    "conda_install": Rule("med", (r"^(conda|mamba|micromamba) ", r" (install|create)( |$)")),
    "build": Rule("med", (r"^(make|cmake|ninja|gcc|g\+\+|clang|clang\+\+|nvcc|cargo|go)(-[0-9]+)?( |$)",)),
    "ssh_cluster": Rule("med", (r"^ssh( -[46AaCfGgKkMNnqsTtVvXxYy]+| -[BbcDEeFIiJLlmOopQRSWw] ?[^ ]+)* ([^ @]+@)?([^ @]*\b)?({cluster})",)),
    "server": Rule("med", (r" -m http\.server( |$)|^(tensorboard|streamlit)( |$)|^jupyter (.* )?(lab|notebook)( |$)|^jupyter-(lab|notebook)( |$)",)),
    "download": Rule("med", (r"^(wget|curl) ", r" (-[A-Za-z]*[oO][A-Za-z]*|--output[^ =]*)([ =]|$)")),
    "hf_download": Rule("med", (r"^(hf|huggingface-cli) ", r" download( |$)")),
    "headless_browser": Rule("low", (r"^(playwright|puppeteer)( |$)",), (r"\b(chromium|chrome|msedge)\b.* --headless", r"(^|[ /])(playwright|puppeteer)/")),
    "force_push": Rule("low", (r"^git( -[cC] [^ ]+| -[^ ]+)* push( |$)", r" (-[A-Za-z]*f[A-Za-z]*|--force)( |$)")),
    "rm_rf": Rule("HIGH", (r"^rm ", r" (-[A-Za-z]*[rR][A-Za-z]*|--recursive)( |$)", r" (-[A-Za-z]*f[A-Za-z]*|--force)( |$)")),
    "chmod_777": Rule("med", (r"^chmod (-[^ ]+ +)*0?777( |$)",)),
}


def rule_set(*, disable: tuple[str, ...] = (), override: dict[str, str] | None = None, add: dict[str, Rule] | None = None, variables: dict[str, str] | None = None) -> dict[str, Rule]:
    """The defaults without the disabled, with other severities and more rules; a rule whose variable is not set drops out."""
    rules = {k: replace(r, severity=(override or {}).get(k, r.severity)) for k, r in {**DEFAULTS, **(add or {})}.items() if k not in disable}
    variables = {"cluster": CLUSTER} if variables is None else variables
    out = {}
    for k, r in rules.items():
        patterns = r.patterns
        for name, value in variables.items():
            patterns = tuple(p.replace("{" + name + "}", value) for p in patterns)
        if not any("{cluster}" in p for p in patterns):
            out[k] = replace(r, patterns=patterns)
    return out


def plain_line(args: Column) -> Column:
    """The line with its program in lower case and without folder."""
    program = F.lower(F.regexp_extract(args, r"^(?:\S*/)?(\S*)", 1))
    return F.concat(program, F.regexp_extract(args, r"^\S*(.*)$", 1))


def risk_panel(records: DataFrame, rules: dict[str, Rule], *, args: str, user: str, key: str, code: Column, signal: Column, instances: int = 3) -> DataFrame:
    """Of each rule: hits, users, how many of the rated (a code, no signal) succeeded, and the first instances.

    Lines are tested once each, not once a record: rules run over distinct lines.
    """
    lines = records.groupBy(F.col(args).alias("_line")).agg(F.count(F.lit(1)).alias("_n")).drop("_n").withColumn("_plain", plain_line(F.col("_line")))

    def holds(r: Rule) -> Column:
        return any_of([all_of([F.col("_plain").rlike(p) for p in r.patterns]), *(F.col("_line").rlike(p) for p in r.anywhere)])

    hit = F.array_compact(F.array(*(F.when(holds(r), F.lit(k)) for k, r in rules.items())))
    hits = lines.select("_line", F.explode(hit).alias("rule"))
    rated = code.isNotNull() & (F.coalesce(signal, F.lit(0)) == 0)
    own = records.withColumns({"_rated": rated, "_good": rated & (code == 0)})
    each = own.join(hits, F.col(args) == F.col("_line"))
    sums = each.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(user).alias("users"), F.count_if("_rated").alias("rated"), F.count_if("_good").alias("succeeded"), F.min(key).alias("first_key"))
    severity = F.create_map(*(F.lit(x) for k, r in rules.items() for x in (k, r.severity)))[F.col("rule")]
    return sums.select("rule", severity.alias("severity"), "n", "users", "rated", "succeeded", F.when(F.col("rated") > 0, pct(F.col("succeeded"), F.col("rated"))).alias("works_pct"), "first_key")
