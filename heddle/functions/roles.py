"""What a process tagged as an agent is, what it was asked for and from where it is driven, read from its own command line; built-in expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of programs, of options and of subcommands.
AGENTS = ("claude", "codex", "cursor-agent", "copilot", "windsurf")
SCRIPT_HOSTS = ("node", "bun", "deno")
SHELLS = ("sh", "bash", "zsh", "dash", "fish")
PYTHON = r"^python(?:\d+(?:\.\d+)*)?$"
LAUNCHER = r"claude-code/cli\.[cm]?js$|@anthropic-ai/claude-code|@openai/codex/bin/codex(?:\.[cm]?js)?$"
SEARCHERS = ("rg", "ugrep", "bfs")
SANDBOX_NAMES = ("bwrap", "codex-linux-sandbox")
IDE_SERVER = r"bootstrap-fork|server-main\.js|--type=extensionHost|--connection-token|\.(?:vscode|cursor|windsurf)-server/cli/servers/[^ ]*/server/(?:node|bin/code-server)(?:\s|$)"
HELPER_FLAGS = ("--claude-in-chrome-mcp", "--chrome-native-host", "--eval-mock-server")
PROBE_FLAGS = ("--version", "-v", "-V", "--help", "-h", "--update")
PROBE_WORDS = ("doctor", "update", "upgrade", "install", "auth", "config", "completion", "setup-token", "migrate-installer", "plugin", "login", "logout", "version", "help", "features", "debug")
CLIENT_WORDS = ("attach", "agents", "queue")
INFRA_WORDS = ("daemon", "bg-pty-host", "rc", "remote-control")
VALUE_FLAGS = (
    "-c --config -m --model --session-id -r --resume --output-format --input-format --effort --sdk-url --permission-mode --add-dir --json-path --log-file --origin --spawned-by -C --cd -s --sandbox"
    " -a --ask-for-approval -p --profile -i --image --agent --settings --mcp-config --append-system-prompt --system-prompt --allowedTools --disallowedTools --fallback-model --max-turns --bg-spare --bg-pty-host --socket --listen"
)
VERSION_NAME = r"^v?(\d+\.\d+\.\d+)(?:[-+][0-9A-Za-z.]+)?$"
VERSION_PATH = r"/(?:versions|ccd-cli|releases)/v?(\d+\.\d+\.\d+)"
EXTENSION = r"/\.([a-z]+)(?:-server(?:-insiders)?)?/extensions/(?:anthropic\.claude-code|openai\.chatgpt)-"
EDITORS = {"vscode": "VS Code", "cursor": "Cursor", "windsurf": "Windsurf", "positron": "Positron"}
SANDBOX_RUNTIME = r"\b_srt_(?:http|socks)=|\bSRT_ALLOW_NESTED_USERNS=|\bARGV0=apply-seccomp\b|\s-c\s+exec 3<&- \|\| exit 126;"

SCRIPT_REACH = 4  # words that an interpreter and its options may take before the script


def _base(word: Column) -> Column:
    """The last step of a path, without the ending of a script."""
    return F.regexp_replace(F.substring_index(word, "/", -1), r"\.[mc]?js$", "")


def _option(name: str) -> str:
    return rf"(?:^|\s)(?:{name})(?=\s|$)"


def _one(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def with_argv(records: DataFrame, *, command: Column, args: Column) -> DataFrame:
    """The records with ``_argv``: their words, where the agent's program stands in them, and what was asked of it.

    A null line has no words. ``at`` counts from 0 and is null where the process is no agent's
    program; ``wrapped`` tells a script of a shell or of Python that only bears an agent's name;
    ``asked`` holds the words after the program that are neither options nor their values.
    """
    line = F.coalesce(args, F.lit(""))
    out = records.withColumns({"_c": F.coalesce(command, F.lit("")), "_w": F.filter(F.split(line, r"\s+"), lambda w: w != "")})
    words, name = F.col("_w"), F.col("_c")
    after = F.slice(words, 2, F.size(words))
    # What a #! line runs: the first word, or what `env` starts.
    runs = F.get(F.filter(after, lambda w: ~w.startswith("-") & ~w.contains("=")), F.lit(0))
    first = F.coalesce(_base(F.get(words, F.lit(0))), F.lit(""))
    out = out.withColumns({"_first": first, "_interp": F.when(first == "env", F.coalesce(_base(runs), F.lit(""))).otherwise(first)})
    near = F.slice(words, 2, SCRIPT_REACH)
    script, inline = F.array_position(F.transform(near, _base), name), F.array_position(near, F.lit("-c"))
    by_name = name.isin(*AGENTS) & (F.size(words) > 1) & (F.col("_interp").isin(*SHELLS, *SCRIPT_HOSTS) | F.col("_interp").rlike(PYTHON)) & (script > 0) & ((inline == 0) | (inline > script))
    place = F.array_position(F.transform(after, lambda w: w.startswith("-")), F.lit(False))
    launched = F.get(after, F.greatest(place - 1, F.lit(0)).cast("int"))
    hosted = name.isin(*SCRIPT_HOSTS) & (place > 0) & (_base(launched).isin(*AGENTS) | launched.rlike(LAUNCHER))
    at = F.when(by_name, script).when(name.isin(*AGENTS) | name.rlike(r"^\d+\.\d+\.\d+"), 0).when(hosted, place)
    out = out.withColumns({"_at": at.cast("int"), "_wrapped": by_name & ~F.col("_interp").isin(*SCRIPT_HOSTS)})
    rest = F.when(F.col("_at").isNotNull(), F.slice(words, F.col("_at") + 2, F.size(words)))
    out = out.withColumn("_rest", rest)
    # An option takes the next word whatever it is, so pairs go from left to right.
    pairs = rf"(?<!\S)(?:{'|'.join(VALUE_FLAGS.split())})\s+\S+"
    asked = F.filter(F.split(F.regexp_replace(F.array_join("_rest", " "), pairs, ""), " +"), lambda w: (w != "") & ~w.startswith("-"))
    argv = F.struct(name.alias("command"), line.alias("line"), words.alias("words"), F.col("_first").alias("first"), F.col("_at").alias("at"), F.col("_wrapped").alias("wrapped"), F.col("_rest").alias("rest"), asked.alias("asked"))
    return out.withColumn("_argv", argv).drop("_c", "_w", "_first", "_interp", "_at", "_wrapped", "_rest")


def subcommand() -> Column:
    """The first word asked of an agent's program; null where there is none."""
    return F.get("_argv.asked", F.lit(0))


def role(kind: Column) -> Column:
    """sandbox, ide, infra, helper, tool-shell, embedded-tool, probe, client or agent, from ``_argv`` and the agent's type."""
    c, line, words, first, at, rest = (F.col(f"_argv.{x}") for x in ("command", "line", "words", "first", "at", "rest"))
    sub, then, kind = subcommand(), F.get("_argv.asked", F.lit(1)), F.coalesce(kind, F.lit(""))
    probes = lambda ws: F.arrays_overlap(ws, F.array(*map(F.lit, PROBE_FLAGS)))
    of_editor = (kind == "vscode") | (kind.isin("cursor", "windsurf") & (line.contains(".cursor-server") | line.contains(".windsurf-server")))
    remote = F.coalesce(F.get(words, F.lit(0)).contains("/.claude/remote/srv/"), F.lit(False))
    lead = F.coalesce(F.get(rest, F.lit(0)), F.lit(""))
    return (
        F.when((kind == "bwrap") | c.startswith("codex-linux-san") | c.startswith("bwrap") | first.isin(*SANDBOX_NAMES), "sandbox")
        .when(of_editor, F.when(c.rlike(r"^code-[0-9a-f]{6,}") | line.rlike(IDE_SERVER), "ide").otherwise("helper"))
        .when(c.startswith("codex-code-mode"), "infra")
        .when(remote, F.when(probes(F.slice(words, 2, F.size(words))), "probe").otherwise("infra"))
        .when(F.col("_argv.wrapped"), "helper")
        .when(at.isNull(), F.when(c.isin(*SHELLS) & line.contains("/.claude/shell-snapshots/"), "tool-shell").otherwise("helper"))
        .when((at == 0) & first.isin(*SEARCHERS), "embedded-tool")
        .when(lead.isin(*HELPER_FLAGS) | lead.startswith("--codex-run-as-"), "helper")
        .when(probes(rest), "probe")
        .when(sub == "app-server", F.when(then == "proxy", "client").when(then == "daemon", "infra").otherwise("agent"))
        .when(sub == "mcp", F.when(then == "serve", "agent").otherwise("probe"))
        .when(sub.isin(*PROBE_WORDS) | sub.startswith("migrate-"), "probe")
        .when(sub.isin(*CLIENT_WORDS), "client")
        .when(sub == "sandbox", "sandbox")
        .when(sub.isin(*INFRA_WORDS), "infra")
        .otherwise("agent")
    )


def version(command: Column, args: Column) -> Column:
    """An agent's version where its program's name or path tells it, else null."""
    return F.coalesce(_one(command, VERSION_NAME), _one(args, VERSION_PATH))


def spawned_by_agent(role: Column, command: Column, args: Column) -> Column:
    """Whether an agent starts such a process itself, so that its parent is the agent."""
    runtime = F.coalesce(args.rlike(SANDBOX_RUNTIME), F.lit(False))
    return F.coalesce(((role == "tool-shell") & ~runtime) | ((role == "sandbox") & F.coalesce(command, F.lit("")).startswith("codex-linux-san")), F.lit(False))


def js_launcher() -> Column:
    """Whether a process only starts an agent's native program from JavaScript, from ``_argv``."""
    hosted = F.col("_argv.command").isin(*SCRIPT_HOSTS) & F.col("_argv.at").isNotNull()
    return F.coalesce(hosted | ((F.col("_argv.at") > 0) & ~F.col("_argv.wrapped")), F.lit(False))


def surface(role: Column, kind: Column, cls: Column, on_tty: Column) -> Column:
    """(name, detail) of where a session is driven from: terminal, script, desktop, extension, web or unknown.

    Only an agent's own process, or one that hosts sessions, tells; all others, people and editors are null.
    """
    line, sub, kind = F.col("_argv.line"), subcommand(), F.coalesce(kind, F.lit(""))
    told = lambda name, detail: F.struct(F.lit(name).alias("name"), (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail"))
    found = _one(line, EXTENSION)
    named = F.coalesce(*(F.when(found == k, v) for k, v in EDITORS.items()), found)
    codex = (
        F.when(sub == "exec", told("script", F.when(line.rlike(_option("--experimental-json")), "Codex SDK").otherwise("codex exec")))
        .when(sub.isin("mcp-server", "mcp"), told("script", "MCP server"))
        .when(sub != "app-server", F.lit(None))
        .when(sub.isNull(), F.lit(None))
        .when(found.isNotNull(), told("extension", named))
        .when(line.rlike(_option("--remote-control")), told("web", "Codex Remote Control"))
        .when(~line.rlike(r"(?:^|\s)--listen[ =]unix://"), told("unknown", "app server"))
        .when(line.rlike(r"features\.code_mode_host=true"), told("desktop", "Codex app"))
        .otherwise(told("unknown", "shared app server"))
    )
    other = (
        F.when(line.contains("/.claude/remote/ccd-cli/"), told("desktop", "Claude desktop app"))
        .when(line.rlike(r"(?:^|\s)--sdk-url(?=[\s=]|$)"), told("web", "Claude Remote Control"))
        .when(sub == "mcp", told("script", "MCP server"))
        .when(line.rlike(_option("--(?:input|output)-format[ =]stream-json")) | line.contains("/claude-agent-sdk"), F.when(found.isNotNull(), told("extension", named)).otherwise(told("script", "Agent SDK")))
        .when(line.rlike(_option("-p|--print")), told("script", F.when(kind == "claude_code", "claude -p").otherwise("-p")))
        .when(sub == "bg-spare", told("terminal", "background session"))
    )
    own = F.coalesce(F.when(kind == "codex", codex).otherwise(other), F.when(found.isNotNull() & ~on_tty, told("extension", named)).otherwise(told("terminal", "interactive")))
    host = (
        F.when(line.contains("/.claude/remote/srv/"), told("desktop", "Claude desktop app"))
        .when(kind == "codex", F.when(sub == "remote-control", told("web", "Codex Remote Control")).when(sub == "app-server", told("unknown", "shared app server")))
        .when(sub.isin("rc", "remote-control"), told("web", "Claude Remote Control"))
        .when(sub.isin("daemon", "bg-pty-host"), told("terminal", "background session"))
    )
    person = F.coalesce(cls.isin("ide", "human"), F.lit(False))
    return F.when(~person & (role == "agent"), own).when(~person & (role == "infra"), host)
