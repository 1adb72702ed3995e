"""Shell command lines: tokens, simple commands, programs and what they are for."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"""\s+|'[^']*'|"(?:\\.|[^"\\])*"|&&|\|\||;;|[;&|\n()<>]|(?:\\.|[^\s'"&|;()<>\\])+|.""", re.S)
_BREAK = {"&&", "||", ";", ";;", "|", "&", "\n", "(", ")"}
_ASSIGN = re.compile(r"[A-Za-z_]\w*=")
_KEYWORDS = {"if", "then", "else", "elif", "fi", "for", "while", "until", "do", "done", "case", "esac", "in", "{", "}", "!", "time"}
_WRAPPERS = {"sudo", "env", "nohup", "nice", "timeout", "stdbuf", "xargs", "exec", "command", "builtin"}

# Programs by category, in order of precedence: our own lists. What no list names is run; cd and its like are nothing.
CATEGORIES = {
    "test": {"pytest", "tox", "nosetests", "ctest", "jest", "mocha", "unittest"},
    "slurm": {"sbatch", "srun", "salloc", "squeue", "sacct", "scancel", "scontrol", "sinfo"},
    "run": {"python", "python3", "node", "java", "ruby", "perl", "Rscript", "julia", "bash", "sh"},
    "build": {"make", "cmake", "ninja", "gcc", "g++", "cc", "clang", "cargo", "go", "mvn", "gradle", "npm", "pip"},
    "edit": {"tee", "patch", "vim", "vi", "nano", "emacs", "cp", "mv", "rm", "mkdir", "touch", "chmod", "ln"},
    "git": {"git", "gh", "svn", "hg"},
    "wait": {"sleep", "wait", "watch", "ps", "pgrep", "pidof"},
    "explore": {"sed", "ls", "cat", "head", "tail", "grep", "rg", "find", "wc", "less", "du", "df", "stat", "file", "tree", "awk", "sort", "uniq", "cut", "diff", "which", "pwd", "echo"},
}
SETUP = {"cd", "pushd", "popd", "export", "source", ".", "set", "unset", "alias", "true", "false", ":", "exit", "return", "module"}
_OF = {p: c for c, ps in reversed(CATEGORIES.items()) for p in ps}


def simple_commands(line: str) -> list[list[str]]:
    """Words of each simple command of a line, quotes taken off."""
    commands: list[list[str]] = [[]]
    skip = False
    words: list[str] = []
    word = None
    for token in _TOKEN.findall(line):
        quoted = token[:1] in "'\"" and len(token) > 1
        if token.isspace() and token != "\n" and "\n" not in token or token in _BREAK or "\n" in token and token.isspace() or token in "<>":
            if word is not None:
                words = [] if skip else [word]
                commands[-1] += words
                skip, word = False, None
            if token in _BREAK or "\n" in token:
                commands.append([])
            elif token in "<>" and token:
                skip = True
            continue
        part = token[1:-1] if quoted else re.sub(r"\\(.)", r"\1", token)
        word = part if word is None else word + part
    if word is not None and not skip:
        commands[-1].append(word)
    return [c for c in commands if c]


def program_of(words: list[str]) -> str:
    """The program of a simple command: past assignments, keywords and wrappers, without its folder."""
    i = 0
    while i < len(words):
        w = words[i]
        if _ASSIGN.match(w) or w in _KEYWORDS:
            i += 1
        elif w.rpartition("/")[2] in _WRAPPERS:
            i += 1
            while i < len(words) and (words[i].startswith("-") or words[i].replace(".", "").rstrip("smh").isdigit()):
                i += 1
        else:
            return w.rpartition("/")[2]
    return ""


def category_of(line: str) -> str:
    """The first category, in order of precedence, of any simple command of the line."""
    commands = simple_commands(line or "")
    found = set()
    for c in commands:
        p = program_of(c)
        if p.startswith("python") and "-m" in c and any(w in CATEGORIES["test"] for w in c):
            p = "pytest"
        if p and p not in SETUP:
            found.add(_OF.get(p, _OF.get(re.sub(r"[\d.]+$", "", p), "run")))
    return next((c for c in CATEGORIES if c in found), "unknown")


@F.pandas_udf(T.StringType())
def _category(lines: pd.Series) -> pd.Series:
    kinds = {x: category_of(x) for x in lines.unique()}
    return lines.map(kinds)


def category(line: Column) -> Column:
    """category_of in Arrow batches, each distinct line of a batch once."""
    return _category(line)


@F.pandas_udf(T.ArrayType(T.StringType()))
def programs(lines: pd.Series) -> pd.Series:
    """Programs of a line's simple commands."""
    return lines.map(lambda x: [p for c in simple_commands(x or "") if (p := program_of(c))])
