"""Deny rules as sequences of words, run over a command's words by one fold.

A rule names programs, and for each of its steps the words of which one must follow, in this order and in the same simple
command. All rules together are one automaton whose states are bits of a long: a word moves the bits whose step it
satisfies to the next step, and a program's bits come in. Each word is looked at once, so time grows with the text only.

The same rules are also regular expressions (`rule_pattern`), for SQL engines whose matching takes linear time.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The step that the end of a simple command satisfies.
END = ("\n",)

# Programs and the words after them, in the order of the system whose rules must match.
KUBE = ("kubectl", "kubecolor", "oc", "k", "kc")
CLOUD = ("aws", "gcloud", "az", "gh")
CLOUD_TOKENS = (
    "get-session-token", "print-access-token", "get-token", "get-access-token", "print-identity-token", "assume-role", "export-credentials", "sso", "application-default",
)
LOADERS = ("BASH_ENV", "SHELLOPTS", "LD_PRELOAD", "LD_AUDIT", "PYTHONSTARTUP", "PERL5OPT", "RUBYOPT", "PROMPT_COMMAND", "command_not_found_handle", "NODE_OPTIONS")
HISTORY = ("HISTFILE",)
PROMPTS = ("PS0", "PS1", "PS2", "PS3", "PS4", "PROMPT_COMMAND")
NETWORK = (
    "curl", "wget", "nc", "ncat", "netcat", "socat", "telnet", "ftp", "sftp", "ssh", "scp", "rsync", "openssl", "dig", "nslookup", "host", "getent", "ping", "traceroute", "whois", "aria2c", "httpie", "http", "xh",
)

# Our own additions to these.
MORE_CLOUD_TOKENS = ("assume-role-*", "get-secret-value")
MORE_LOADERS = ("LD_LIBRARY_PATH", "DYLD_INSERT_LIBRARIES", "GIT_SSH_COMMAND", "PS0", "PS4")
FORGES, CONTAINERS = ("gh", "glab"), ("docker", "podman", "nerdctl")

RULES: tuple[tuple, ...] = (
    ("kubernetes secrets", KUBE, ("get", "describe", "edit"), ("secret*", "*/secret*", "*,secret*")),
    ("pod access", KUBE, ("exec", "cp", "debug", "attach")),
    ("kubernetes token", KUBE, ("create",), ("token",)),
    ("cluster tunnel", KUBE, ("port-forward", "proxy")),
    ("cluster configuration", KUBE, ("config",), ("view",)),
    ("terraform state", ("terraform", "tofu"), ("state", "console", "show", "output")),
    ("cloud token", CLOUD, (*CLOUD_TOKENS, *MORE_CLOUD_TOKENS)),
    ("forge token", FORGES, ("auth",), ("token", "status")),
    ("forge token", FORGES, ("secret", "variable")),
    ("forge call", FORGES, ("api",)),
    ("chart values", ("helm",), ("get",), ("values", "all", "manifest")),
    ("secret store", ("vault", "op", "bw", "pass", "gopass"), ("read", "get", "show", "kv")),
    ("key export", ("gpg", "gpg2"), ("--export-secret-*",)),
    ("keychain", ("security",), ("find-generic-password", "find-internet-password", "dump-keychain")),
    ("attached debugger", ("gdb", "strace", "ltrace", "lldb"), ("-p*", "--pid*", "attach")),
    ("environment of other processes", ("ps",), ("auxe*", "axe*", "e", "ewww", "eww", "-E*", "environ", "*,environ*")),
    ("service environment", ("systemctl",), ("show-environment", "show")),
    ("container environment", CONTAINERS, ("inspect",)),
    ("mounted secrets", CONTAINERS, ("run", "create"), ("*.ssh*", "*.aws*", "*.kube*", "*.gnupg*", "*/etc/ssl*")),
    ("git configuration", ("git",), ("config",), END),
    ("git remotes", ("git",), ("remote",), ("-v", "-vv", "--verbose", "get-url", "show")),
    ("cron table", ("crontab",), ("-l",)),
    ("loaded code", (".", "source"), ("/tmp/*", "/dev/*", "/var/tmp/*")),
    ("loaded code", ("printf",), ("-v",), PROMPTS),
    ("state folder", ("find", "grep", "rg", "tar", "cp", "ls", "tree", "du"), ("*.local/state", "*.local/state/", "*.local/state/veilmill*", "*.local/state/[*]*")),
    ("editor command", ("vim", "vi", "nvim", "ex", "emacs"), ("-c*", "--cmd*", "--eval*", "+:*", "+!*")),
)
#: By rule: words after which it can no longer apply to the command. Names and addresses of authors are no secret.
PARDONS = {"git configuration": ("user.name", "user.email")}

#: What ends a simple command, what parts words, and the borders before a program and behind the last word.
BREAK, BLANK, WORD = r"[;|&\r\n]", r"[ \t]", r"[^ \t;|&\r\n]"
BEFORE, BEHIND = r"(^|[ \t\r\n;|&(/])", r"($|[ \t\r\n;|&)])"


def _bits() -> tuple[list[tuple[int, tuple]], int]:
    """First bit of each rule, and the bits of last steps."""
    out, at, last = [], 0, 0
    for rule in RULES:
        out.append((at, rule))
        at += len(rule) - 2
        last |= 1 << at - 1
    if at > 62:
        raise ValueError("the rules have more steps than a long has bits")
    return out, last


FIRST, LAST = _bits()


@cache
def _tables() -> tuple[dict[str, int], dict[str, int], tuple[tuple[str, int], ...], dict[str, int]]:
    """Bits by program, by plain word, by glob, and what words clear."""
    programs, words, globs, cleared = {}, {}, {}, {}
    for at, (reason, names, *steps) in FIRST:
        for n in names:
            programs[n] = programs.get(n, 0) | 1 << at
        for i, step in enumerate(steps):
            for w in step:
                table = globs if re.search(r"[*?\[]", w) else words
                table[w] = table.get(w, 0) | 1 << at + i
        for w in PARDONS.get(reason, ()):
            cleared[w] = cleared.get(w, 0) | (1 << at + len(steps)) - (1 << at)
    return programs, words, tuple(globs.items()), cleared


def _glob_pattern(glob: str) -> str:
    """A glob over a word, up to its end."""
    return "".join({"*": WORD + "*"}.get(c, re.escape(c)) for c in glob.replace("[*]", "\0")).replace("\0", r"\*").replace(re.escape("\0"), r"\*")


# The fold in the JVM


def _mask(key: Column, table: dict[str, int]) -> Column:
    entries = F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.lit(v).cast("bigint"))))
    return F.coalesce(F.element_at(entries, key), F.lit(0).cast("bigint"))


def tokens(text: Column) -> Column:
    """The words of text, with a line end for each end of a simple command, and one at the end."""
    return F.filter(F.split(F.concat(F.regexp_replace(text, BREAK + "+", " \n "), F.lit(" \n")), BLANK + "+"), lambda x: x != "")


def fired(text: Column) -> Column:
    """The bits of the last steps of the rules that text breaks."""
    programs, words, globs, cleared = _tables()
    any_glob = "|".join(f"(?:{_glob_pattern(g)})" for g, _ in globs)

    def masks(x: Column) -> Column:
        by_glob = F.lit(0).cast("bigint")
        for g, bits in globs:
            by_glob = by_glob.bitwiseOR(F.when(x.rlike(rf"\A(?:{_glob_pattern(g)})(?:\)|\z)"), F.lit(bits).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
        head = F.substring_index(x, ")", 1)
        step = _mask(head, words).bitwiseOR(F.when(x.rlike(rf"\A(?:{any_glob})"), by_glob).otherwise(F.lit(0).cast("bigint")))
        return F.struct(_mask(F.regexp_extract(x, r"[^(/]*\z", 0), programs).alias("p"), step.alias("s"), _mask(head, cleared).alias("c"), (x == "\n").alias("end"))

    start = F.struct(F.lit(0).cast("bigint").alias("m"), F.lit(0).cast("bigint").alias("out"))

    def step(s: Column, x: Column) -> Column:
        moved = s["m"].bitwiseAND(x["s"])
        on = s["m"].bitwiseOR(F.shiftleft(moved.bitwiseAND(F.lit(~LAST).cast("bigint")), 1)).bitwiseOR(x["p"]).bitwiseAND(F.bitwise_not(x["c"]))
        return F.struct(F.when(x["end"], F.lit(0).cast("bigint")).otherwise(on).alias("m"), s["out"].bitwiseOR(moved.bitwiseAND(F.lit(LAST).cast("bigint"))).alias("out"))

    return F.aggregate(F.transform(tokens(text), masks), start, step, lambda s: s["out"])


def reason(text: Column) -> Column:
    """The first rule that text breaks; null for none."""
    last_bit = [(at + len(steps) - 1, name) for at, (name, _, *steps) in FIRST]
    table = F.array(*(F.struct(F.lit(1 << b).cast("bigint").alias("bit"), F.lit(n).alias("name")) for b, n in last_bit))
    hit = lambda bits: F.get(F.filter(table, lambda r: r["bit"].bitwiseAND(bits) != 0), F.lit(0))["name"]
    return F.get(F.transform(F.array(fired(text)), hit), F.lit(0))


# The same for one text in a Python worker


def broken(text: str) -> str | None:
    """reason() of one text."""
    programs, words, globs, cleared = _tables()
    m = out = 0
    for x in [t for t in re.split(BLANK + "+", re.sub(BREAK + "+", " \n ", text) + " \n") if t]:
        head = x.split(")", 1)[0]
        step = words.get(head, 0)
        for g, bits in globs:
            if bits & m and re.match(rf"(?:{_glob_pattern(g)})(?:\)|\Z)", x):
                step |= bits
        moved = m & step
        m = 0 if x == "\n" else (m | (moved & ~LAST) << 1 | programs.get(re.search(r"[^(/]*\Z", x).group(), 0)) & ~cleared.get(head, 0)
        out |= moved & LAST
    return next((name for at, (name, _, *steps) in FIRST if out >> at + len(steps) - 1 & 1), None)


# And as regular expressions for engines of linear time


def rule_pattern(rule: tuple) -> str:
    """RE2's form of a rule. Where the end of the command is its last step, the match is the command's rest, see reason_sql()."""
    _, programs, *steps = rule
    out = rf"{BEFORE}({'|'.join(map(re.escape, programs))})"
    for i, step in enumerate(steps):
        if step == END:
            return out + rf"(\)?{BLANK}[^;|&\r\n]*|\)[^;|&\r\n]*)?($|{BREAK})"
        tail = "" if i + 1 == len(steps) else rf"(\){WORD}*)?"
        out += rf"({BLANK}[^;|&\r\n]*)?{BLANK}({'|'.join(map(_glob_pattern, step))}){tail}"
    return out + BEHIND


def rule_sql(rule: tuple, text: str, quoted) -> str:
    pattern, pardons = quoted(rule_pattern(rule)), PARDONS.get(rule[0], ())
    if rule[-1] != END:
        return f"regexp_matches({text}, {pattern})"
    pardoned = quoted(rf"{BLANK}({'|'.join(map(re.escape, pardons))})($|[ \t);|&\r\n])")
    return f"len(list_filter(regexp_extract_all({text}, {pattern}), lambda hit: NOT regexp_matches(hit, {pardoned}))) > 0"


# Network programs


#: Words after which the next word is still a program's place.
_LEADS = ("sudo", "doas", "nohup", "time", "nice", "ionice", "timeout", "xargs", "command", "builtin", "exec", "stdbuf", "setsid", "watch", "env", "then", "do", "else", "if", "while", "until", "!", "{", "-exec", "-execdir")


def network_calls(text: Column) -> Column:
    """Whether a network program stands where a command begins: in front, or behind assignments, options and programs that run others."""
    lead = rf"\A(?:[A-Za-z_][A-Za-z0-9_]*=.*|-.*|[0-9.]+[smhd]?|{'|'.join(re.escape(w) for w in _LEADS)})\z"
    name = lambda x: F.regexp_extract(x, r"[^(/`\"']*\z", 0)
    start = F.struct(F.lit(True).alias("head"), F.lit(False).alias("found"))

    def step(s: Column, x: Column) -> Column:
        here = s["head"] | x.rlike(r"\A\S*(?:\$\(|`|<\()")
        return F.struct(((x == "\n") | (s["head"] & x.rlike(lead)) | x.isin("-exec", "-execdir", "xargs")).alias("head"), (s["found"] | (here & F.lower(name(x)).isin(*NETWORK))).alias("found"))

    return F.aggregate(tokens(text), start, step, lambda s: s["found"])


#: Options that lead elsewhere than the URL says, and the shell's own sockets.
_ELSEWHERE = r"(?i)(?:^|[ \t])(?:--(?:abstract-)?unix-socket|--proxy|--preproxy|--socks5?[a-z-]*|-x|--connect-to|--resolve|-K|--config)(?:=|[ \t]|$)|/dev/(?:tcp|udp)/"


def network_reason(text: Column, domains: list[str]) -> Column:
    """Network programs may only reach this machine and the open domains, by URL; whatever can't be told to is refused."""
    from .rules import is_local, is_open_host, url_host

    urls = F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z0-9+.-]{0,20}://[^\s\"'|;&()<>]+"), F.lit(0))
    fine = (F.size(urls) > 0) & F.forall(urls, lambda u: is_local(u) | F.coalesce(is_open_host(url_host(u), domains), F.lit(False)))
    elsewhere = text.rlike(_ELSEWHERE)
    return F.when(text.rlike(r"(?i)/dev/(?:tcp|udp)/") | (network_calls(text) & (elsewhere | ~fine)), F.lit("network destination"))

