"""Records as they arrive: normalised, searched, masked, judged by rules; tables as in ``queries``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import measures as M
from ..functions import taxonomy, text
from ..operators import normalize as nz
from ..operators import risk
from ..sources import feeds, key_index
from .queries import E_SQL, S, dpct, dsum, events, masked_sql, query, read
from .scratch import scratch

# What the records lack in the tables is derived from k, alike on both sides.
ARGS = (
    "codex --yolo", "claude --permission-mode=plan x", "/home/u/.vscode-server/bin/node a", "git status", "run approval_policy = never", "claude --permission-mode auto", "codex -a never x",
    "codex app-server", "claude --permission-mode acceptEdits", "claude --permission-mode=bypassPermissions", "codex -s danger-full-access", "claude",
)
COMMANDS = ("git", "ls", "python", "make", "squeue", "vim")


def _pick(values: tuple[str, ...], by: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(by) % len(values) + 1).cast("int"))


def _pick_sql(values: tuple[str, ...], by: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][{by} % {len(values)} + 1]"


def _raw(spark, d):
    return events(spark, d).select(
        "event_id",
        F.when(F.col("k") % 4 == 1, 3).when(F.col("k") % 4 == 2, 5).when(F.col("k") % 4 == 3, 8).alias("schema_version"),
        F.col("ts").cast("string").alias("ts"), (F.col("us") / S).alias("ts_epoch"),
        F.col("host").cast("string").alias("host"), F.col("user_id").cast("string").alias("user"),
        F.when(F.col("cls").isin("click", "purchase"), "agent").when(F.col("cls") == "view", "human").when(F.col("cls") == "signup", "human-vscode").alias("actor3"),
        F.when(F.col("cls") == "click", _pick(("claude", "codex"), "k")).alias("agent_type"),
        F.when(F.col("cls") == "click", F.col("user_id")).alias("agent_pid"),
        F.when(F.col("k") % 7 == 0, F.concat(F.lit("apid:"), F.col("user_id").cast("string"))).alias("session_key"),
        F.when((F.col("cls") == "view") & (F.col("k") % 2 == 0), F.concat(F.lit("/user/session-"), F.col("host").cast("string"), F.lit(".scope"))).alias("cgroup"),
        F.when(F.col("k") % 3 == 0, F.concat(F.lit("pts/"), F.col("host").cast("string"))).alias("tty"),
        _pick(COMMANDS, "event_id").alias("command"), _pick(ARGS, "k").alias("args"),
        F.when(F.col("k") % 8 > 0, F.col("k") / 10.0).cast("double").alias("duration_s"), (F.col("value") / 100).alias("cpu_s"),
        F.when(F.col("k") % 23 == 5, "bypassed").alias("approval_mode"), F.when(F.col("k") % 5 == 0, "sandboxed").when(F.col("k") % 5 == 1, "unsandboxed").alias("sandbox"), F.when(F.col("k") % 5 == 2, "denied").alias("sandbox_src"),
        F.col("k").cast("double").alias("blkio_wait_s"), (F.col("k") % 9).cast("double").alias("dstate_wait_s"),
    )


RAW_SQL = f"""{E_SQL}, raw AS (SELECT event_id, CASE k % 4 WHEN 1 THEN 3 WHEN 2 THEN 5 WHEN 3 THEN 8 END AS sv0, strftime(ts, '%Y-%m-%d') AS day, CAST(host AS VARCHAR) AS host, CAST(user_id AS VARCHAR) AS usr,
CASE WHEN cls IN ('click', 'purchase') THEN 'agent' WHEN cls = 'view' THEN 'human' WHEN cls = 'signup' THEN 'human-vscode' END AS actor3, CASE WHEN cls = 'click' THEN user_id END AS agent_pid,
CASE WHEN k % 7 = 0 THEN CAST(user_id AS VARCHAR) END AS skey, CASE WHEN cls = 'view' AND k % 2 = 0 THEN CAST(host AS VARCHAR) END AS scope, CASE WHEN k % 3 = 0 THEN 'pts/' || host END AS tty,
{_pick_sql(COMMANDS, "event_id")} AS command, {_pick_sql(ARGS, "k")} AS args, CASE WHEN cls = 'click' THEN ['claude', 'codex'][k % 2 + 1] END AS kind, k, CASE WHEN k % 8 > 0 THEN k / 10.0::DOUBLE END AS dur, value / 100 AS cpu, CAST(k AS DOUBLE) AS blk, CAST(k % 9 AS DOUBLE) AS dst FROM e),
g AS (SELECT *, coalesce(sv0, 3) AS sv, coalesce(dur + 1.0, 604800.0) AS lim, skey IS NOT NULL OR agent_pid IS NOT NULL AS ag FROM raw),
n AS (SELECT *, CASE WHEN sv >= 4 THEN blk END AS b4, CASE WHEN sv >= 4 THEN dst END AS d4,
CASE WHEN actor3 = 'human-vscode' OR (actor3 = 'human' AND args LIKE '%/.vscode-server/%') THEN 'ide' ELSE coalesce(actor3, 'unlabeled') END AS a3,
CASE WHEN ag THEN 'apid' WHEN scope IS NOT NULL THEN 'sess' WHEN tty IS NOT NULL THEN 'tty' ELSE 'usr' END AS kt,
CASE WHEN ag THEN coalesce(skey, CAST(agent_pid AS VARCHAR)) WHEN scope IS NOT NULL THEN scope WHEN tty IS NOT NULL THEN usr || '@' || tty ELSE usr END AS kv FROM g)"""


@query(f"""WITH {RAW_SQL} SELECT event_id, CAST(sv AS INTEGER) AS _sv, a3 AS _a3, command AS _command,
CASE command WHEN 'git' THEN 'git' WHEN 'ls' THEN 'filesearch' WHEN 'python' THEN 'compute' WHEN 'make' THEN 'build' WHEN 'squeue' THEN 'slurm_mon' ELSE 'editor' END AS _purpose,
CASE WHEN dur >= 0.01 THEN round(100.0 * cpu / dur, 4) END AS cpu_pct, kt AS _kt, kv AS _kv, host || '|' || day || '|' || a3 || '|' || kt || ':' || kv AS _sid,
CASE WHEN a3 IN ('human', 'ide') THEN 'na' WHEN kind IS NULL THEN 'unknown' WHEN k % 23 = 5 OR args IN ('codex --yolo', 'run approval_policy = never', 'codex -a never x', 'claude --permission-mode=bypassPermissions', 'codex -s danger-full-access') THEN 'bypassed'
WHEN args = 'claude --permission-mode auto' THEN 'auto' WHEN args = 'codex app-server' AND kind = 'codex' THEN 'unobservable' ELSE 'supervised' END AS _approval,
CASE WHEN sv < 5 THEN 'unknown' WHEN k % 5 = 0 THEN 'sandboxed' WHEN k % 5 = 1 THEN 'unsandboxed' WHEN k % 5 = 2 THEN 'denied' ELSE 'unknown' END AS _sandbox,
concat_ws(',', CASE WHEN b4 > lim THEN 'blkio_wait_s' END, CASE WHEN d4 > lim THEN 'dstate_wait_s' END) AS impossible, CASE WHEN b4 <= lim THEN b4 END AS blkio_wait_s, CASE WHEN d4 <= lim THEN d4 END AS dstate_wait_s FROM n""")
def normalized_records(spark, d):
    n = nz.normalize(_raw(spark, d))
    return n.select("event_id", "_sv", "_a3", "_command", "_purpose", F.round("_cpu_pct", 4).alias("cpu_pct"), "_kt", "_kv", "_sid", "_approval", "_sandbox", F.array_join("_impossible", ",").alias("impossible"), "blkio_wait_s", "dstate_wait_s")


@query(f"""WITH {E_SQL}, x AS (SELECT cls, value AS r, CASE WHEN k % 5 > 0 THEN value * (k % 3) / 2 END AS q FROM e), y AS (SELECT *, CASE WHEN r IS NOT NULL AND q IS NOT NULL THEN greatest(0.0, r - q) END AS served FROM x),
s AS (SELECT cls, count(*) AS seen, count(served) AS n, {dsum("r")} AS read, {dsum("q")} AS disk, {dsum("served")} AS served, {dsum("CASE WHEN served IS NOT NULL THEN r END")} AS both_ FROM y GROUP BY cls)
SELECT cls, seen, n, read, disk, served, {dpct("served", "both_")} AS hit_pct, {dpct("n", "seen")} AS coverage_pct FROM s""")
def io_by_class(spark, d):
    disk = F.when(F.col("k") % 5 > 0, F.col("value") * (F.col("k") % 3) / 2)
    return nz.io_by_class(events(spark, d).withColumn("disk", disk), cls="cls", read="value", disk="disk")


SUBMITS = ("sbatch --test-only a.sh", "sbatch a.sh", "srun --jobid=5 x", "srun --overlap x", "salloc", "sbatch --mem=4G b.sh")


@query(f"""WITH {E_SQL}, x AS (SELECT event_id, {_pick_sql(SUBMITS, "k")} AS args, CASE WHEN k % 4 = 1 THEN event_id END AS job, k % 3 AS code, k % 10 = 0 AS refused FROM e)
SELECT CASE WHEN args LIKE '%--test-only%' THEN 'dry_run' WHEN job IS NOT NULL THEN 'job' WHEN args LIKE '% --jobid%' OR args LIKE '% --overlap%' THEN 'step' WHEN code <> 0 AND (args LIKE 'sbatch%' OR refused) THEN 'rejected' ELSE 'no_id' END AS outcome,
count(*) AS n, count(*) FILTER (code = 0) AS ended_well FROM x GROUP BY 1""")
def submit_outcomes(spark, d):
    args, code = _pick(SUBMITS, "k"), F.col("k") % 3
    outcome = taxonomy.submit_outcome(args, F.when(F.col("k") % 4 == 1, F.col("event_id")), code, F.split(args, " ")[0], F.col("k") % 10 == 0)
    return events(spark, d).groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.count_if(code == 0).alias("ended_well"))


@query(f"WITH {E_SQL}, x AS (SELECT CASE WHEN k % 4 = 0 THEN 'none' WHEN k % 4 = 1 THEN 'none' ELSE 'tag-' || (k % 4) END AS tag, value FROM e) SELECT tag, count(*) AS n, {dsum('value')} AS cost FROM x GROUP BY tag")
def untagged_as_none(spark, d):
    tag = F.when(F.col("k") % 4 == 0, None).when(F.col("k") % 4 == 1, "").otherwise(F.concat(F.lit("tag-"), (F.col("k") % 4).cast("string")))
    return events(spark, d).groupBy(M.none_token(tag).alias("tag")).agg(F.count(F.lit(1)).alias("n"), M.exact_sum("value").alias("cost"))


@query(f"WITH {E_SQL} SELECT event_id, us, cls, value FROM e WHERE user_id = 7")
def key_search(spark, d):
    path = scratch(spark, "history")
    feeds.write_history(read(spark, d, "events"), path, ts="ts", kind="event_type")
    index = scratch(spark, "index")
    key_index.extend_key_index(spark, path, index, key="user_id")
    found = key_index.search_keys(spark, path, index, key="user_id", keys=[7])  # reads the files that hold it
    return found.select("event_id", M.micros(F.col("ts")).alias("us"), F.col("event_type").alias("cls"), "value")


@query(f"WITH {E_SQL} SELECT event_id, user_id, cls FROM e WHERE cls = 'error' AND user_id % 10 = 3")
def prefiltered_lines(spark, d):
    e = events(spark, d).select("event_id", "user_id", "cls")
    path = scratch(spark, "feed")
    e.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return feeds.read_jsonl(spark, path, e.schema, holds=['"cls":"error"'])[0].filter("cls = 'error' AND user_id % 10 = 3")


@query("""SELECT n_name AS domain, count(*) AS users, CAST(sum(CAST(c_acctbal AS DECIMAL(18,4))) AS DOUBLE) AS balance FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 > 0) ON c_nationkey = n_nationkey GROUP BY 1""")
def users_by_domain(spark, d):
    path = scratch(spark, "lookup")
    read(spark, d, "nation").filter("n_nationkey % 4 > 0").select("n_nationkey", "n_name").write.option("header", True).csv(path)  # the lookup lacks some keys
    joined = feeds.with_lookup(read(spark, d, "customer"), feeds.read_lookup(spark, path, key="n_nationkey", take=["n_name"]), on="c_nationkey", key="n_nationkey")
    return joined.groupBy(F.col("n_name").alias("domain")).agg(F.count(F.lit(1)).alias("users"), M.exact_sum("c_acctbal").alias("balance"))


@query(f"SELECT source, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE contains(lower({masked_sql('text')}), 'the th') GROUP BY source")
def search_in_masked_text(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "source", "text")
    return docs.filter(F.lower(text.mask(F.col("text"))).contains("the th")).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


#: Command lines, each with the rules that hold for it, told by hand.
RISKY_LINES = (
    ("/usr/bin/nvidia-smi -L", "nvidia_smi"), ("nvcc a.cu", "build"), ("pip3 install x", "pip_install"), ("python3 -m pip install y", "pip_install"), ("pip list", ""), ("pip4 install x", ""), ("conda create -n z", "conda_install"),
    ("mamba list", ""), ("micromamba install q", "conda_install"), ("make-4 all", "build"), ("gcc-12 a.c", "build"), ("clang++ a.cc", "build"), ("go build ./...", "build"), ("ssh -A bob@node7", "ssh_cluster"), ("ssh github.com", ""),
    ("ssh -p 22 -i k gpu-3", "ssh_cluster"), ("ssh login1 node7", ""), ("jupyter lab", "server"), ("jupyter nbconvert a", ""), ("jupyter-notebook", "server"), ("python3 -m http.server 80", "server"), ("streamlit run a.py", "server"),
    ("nginx -s reload", ""), ("wget http://x/y -O z", "download"), ("curl -sO http://x", "download"), ("curl --output-dir d http://x", "download"), ("curl http://x", ""), ("hf download m", "hf_download"), ("hf upload m", ""),
    ("chrome --headless=new x", "headless_browser"), ("/opt/msedge -x --headless", "headless_browser"), ("playwright test", "headless_browser"), ("node /a/node_modules/puppeteer/cli.js", "headless_browser"), ("chrome x", ""),
    ("git push -f origin", "force_push"), ("git -C r push --force", "force_push"), ("git push --force-with-lease", ""), ("git push", ""), ("rm -rf tmp", "rm_rf"), ("rm -r -f a", "rm_rf"), ("rm -r a", ""), ("chmod 777 x", "chmod_777"),
    ("chmod -R 777 x", "chmod_777"), ("chmod 755 x", ""), ("ls -la", "listing"), ("/opt/Rm --recursive --force q", "rm_rf"), ("cargo build", "build"), ("echo rm -rf", ""),
)
LINES = tuple(line for line, _ in RISKY_LINES)
RISKS = risk.rule_set(disable=("nvcc",), override={"server": "HIGH"}, add={"listing": risk.Rule("low", (r"^ls( |$)",))})
RISK_SQL = f"""WITH {E_SQL}, l AS (SELECT *, {_pick_sql(LINES, "k")} AS args, CASE WHEN k % 10 = 9 THEN NULL ELSE k % 4 END AS code, CASE WHEN k % 20 = 7 THEN 9 ELSE 0 END AS sig FROM e),
told(line, rule) AS (VALUES {", ".join(f"('{line}', '{rule}')" for line, rule in RISKY_LINES if rule)}),
s(rule, severity) AS (VALUES ('nvidia_smi', 'low'), ('pip_install', 'med'), ('conda_install', 'med'), ('build', 'med'), ('ssh_cluster', 'med'), ('server', 'HIGH'), ('download', 'med'), ('hf_download', 'med'),
  ('headless_browser', 'low'), ('force_push', 'low'), ('rm_rf', 'HIGH'), ('chmod_777', 'med'), ('listing', 'low')),
h AS (SELECT l.*, rule, severity, code IS NOT NULL AND sig = 0 AS rated FROM l JOIN told ON line = args JOIN s USING (rule))
SELECT rule, any_value(severity) AS severity, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (rated) AS rated, count(*) FILTER (rated AND code = 0) AS succeeded,
CASE WHEN count(*) FILTER (rated) > 0 THEN round(100.0::DOUBLE * count(*) FILTER (rated AND code = 0) / count(*) FILTER (rated), 2) END AS works_pct, min(event_id) AS first_key FROM h GROUP BY rule"""


@query(RISK_SQL)
def command_risks(spark, d):
    code = F.when(F.col("k") % 10 == 9, None).otherwise(F.col("k") % 4)
    signal = F.when(F.col("k") % 20 == 7, 9).otherwise(0)
    return risk.risk_panel(events(spark, d).withColumn("args", _pick(LINES, "k")), RISKS, args="args", user="user_id", key="event_id", code=code, signal=signal)
