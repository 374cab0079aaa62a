"""Reading shell command lines: simple commands as words, whatever quotes, substitutions and here-documents they stand in."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Substitutions inside one another, and words that braces may expand to, before a line counts as unreadable.
DEPTH, WORDS = 4, 64
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
KEYWORDS = ("if", "then", "else", "elif", "fi", "for", "while", "until", "do", "done", "case", "esac", "in", "function", "select", "!", "coproc")
#: Of these, those whose next words are no command.
HEADERS = ("for", "case", "function", "select")


class Unreadable(ValueError):
    """The line can't be read to its end, or says what only running it can tell."""


@dataclass
class Word:
    text: str = ""
    #: Names of the variables that it expands; whether a command's output stands in it; whether a glob does.
    variables: list[str] = field(default_factory=list)
    computed: bool = False
    glob: bool = False
    quoted: bool = False

    def add(self, text: str) -> None:
        self.text += text


@dataclass
class Command:
    words: list[Word] = field(default_factory=list)
    #: Files of redirections; bodies of here-documents and here-strings.
    files: list[Word] = field(default_factory=list)
    inputs: list[str] = field(default_factory=list)
    #: Whether it reads what another command writes.
    piped: bool = False


class Reader:
    """One pass over a script; commands holds the simple commands, those of substitutions too."""

    def __init__(self, script: str, depth: int = 0):
        if depth > DEPTH:
            raise Unreadable("too deep")
        self.s, self.i, self.depth = script, 0, depth
        self.commands: list[Command] = []
        self.waiting: list[tuple[Command, str, bool]] = []

    def read(self) -> list[Command]:
        self.list_until("")
        if self.waiting:
            raise Unreadable("here-document without end")
        return [c for c in self.commands if c.words or c.files]

    def inner(self, script: str) -> None:
        self.commands += Reader(script, self.depth + 1).read()

    def list_until(self, stop: str) -> None:
        command, opened = Command(), []
        self.commands.append(command)
        while self.i < len(self.s):
            c = self.s[self.i]
            if c == stop and not opened:
                self.i += 1
                return
            if c in " \t\r":
                self.i += 1
            elif c == "#":
                end = self.s.find("\n", self.i)
                self.i = len(self.s) if end < 0 else end
            elif self.s.startswith("((", self.i) and not command.words:
                end = self.s.find("))", self.i)
                if end < 0:
                    raise Unreadable("arithmetic without end")
                self.i = end + 2
            elif c in "<>" and self.s[self.i + 1 : self.i + 2] == "(" or self.s.startswith("&>", self.i) or c in "<>":
                self.redirection(command)
            elif c in "\n;|&(){}":
                if c in "({" and (c == "(" or self.s[self.i + 1 : self.i + 2].isspace()):
                    opened.append(")" if c == "(" else "}")
                elif c in ")}" and opened and opened[-1] == c:
                    opened.pop()
                elif c == "{" or (c == "}" and not opened):
                    command.words += [w for w in self.word() if w.text]
                    continue
                elif c == ")" and not any(w.text == "case" for k in self.commands for w in k.words[:1]):
                    raise Unreadable("a bracket too many")
                piped = c == "|" and self.s[self.i + 1 : self.i + 2] != "|" and self.s[self.i - 1 : self.i] != "|"
                self.i += 1
                if c == "\n":
                    self.documents()
                command = Command(piped=piped or (command.piped and not command.words))
                self.commands.append(command)
            else:
                if re.compile(r"[0-9]+(?=[<>])").match(self.s, self.i) and (m := re.compile(r"[0-9]+").match(self.s, self.i)):
                    self.i = m.end()
                    continue
                words = self.word()
                if not command.words and len(words) == 1 and words[0].text in KEYWORDS and not words[0].quoted:
                    if words[0].text in HEADERS:
                        command.words += words
                    continue
                command.words += [w for w in words if w.text or w.quoted or w.variables or w.computed]
        self.documents()
        if stop or opened:
            raise Unreadable("a bracket without end")

    def redirection(self, command: Command) -> None:
        if self.s.startswith(("<(", ">("), self.i):
            self.i += 2
            self.substitution()
            command.words.append(Word("/dev/fd", computed=True))
            return
        m = re.compile(r"<<<|<<-?|&>>?|[<>]&|<>|>>|>\||[<>]").match(self.s, self.i)
        self.i = m.end()
        while self.i < len(self.s) and self.s[self.i] in " \t":
            self.i += 1
        words = self.word() if self.i < len(self.s) and self.s[self.i] not in "\n;|&()" else []
        if not words:
            raise Unreadable("redirection to nothing")
        if m.group() in ("<<", "<<-"):
            self.waiting.append((command, words[0].text, words[0].quoted))
        elif m.group() == "<<<":
            command.inputs.append(words[0].text)
        else:
            command.files += words

    def documents(self) -> None:
        for command, end, quoted in self.waiting:
            lines = []
            while True:
                if self.i >= len(self.s):
                    raise Unreadable("here-document without end")
                stop = self.s.find("\n", self.i)
                line = self.s[self.i : stop if stop >= 0 else len(self.s)]
                self.i = stop + 1 if stop >= 0 else len(self.s)
                if line.lstrip("\t") == end:
                    break
                lines.append(line)
            body = "\n".join(lines)
            command.inputs.append(body)
            if not quoted and ("$(" in body or "`" in body):
                self.inner(" ".join(f'"{x}"' for x in re.findall(r"\$\([^()]*\)|`[^`]*`", body)) or "true")
        self.waiting = []

    def substitution(self) -> None:
        """After $( or the like: the commands up to its bracket."""
        sub = Reader(self.s, self.depth + 1)
        sub.i = self.i
        sub.list_until(")")
        self.commands += sub.commands
        self.i = sub.i

    def expansion(self, word: Word) -> None:
        s, i = self.s, self.i
        if s.startswith("$((", i):
            end = s.find("))", i)
            if end < 0:
                raise Unreadable("arithmetic without end")
            word.variables += NAME.findall(s[i + 3 : end])
            word.add("0")
            self.i = end + 2
        elif s.startswith("$(", i):
            self.i += 2
            self.substitution()
            word.computed = True
        elif s[i] == "`":
            end = i + 1
            while end < len(s) and s[end] != "`":
                end += 2 if s[end] == "\\" else 1
            if end >= len(s):
                raise Unreadable("a backtick without end")
            self.inner(s[i + 1 : end].replace("\\`", "`"))
            word.computed = True
            self.i = end + 1
        elif s.startswith("${", i):
            depth, end = 1, i + 2
            while end < len(s) and depth:
                depth += {"{": 1, "}": -1}.get(s[end], 0)
                end += 2 if s[end] == "\\" else 1
            if depth:
                raise Unreadable("an expansion without end")
            body = s[i + 2 : end - 1]
            if body.startswith("!") or body.endswith("@P"):
                raise Unreadable("a variable that names a variable, or is run")
            m = NAME.match(body)
            if m:
                word.variables.append(m.group())
                body = body[m.end() :]
            if re.search(r"[$`]", body):
                self.inner(f'"{body}"' if body.count('"') % 2 == 0 else body)
            word.add(re.sub(r"\A:?[-=+?]", "", body) if m else "")
            self.i = end
        elif m := NAME.match(s, i + 1):
            word.variables.append(m.group())
            self.i = m.end()
        else:
            word.add("$")
            self.i += 2 if s[i + 1 : i + 2] in tuple("0123456789@*#?$!-") and s[i + 1 : i + 2] else 1

    def word(self) -> list[Word]:
        """The words that stand here, several if braces expand."""
        s, word, braced = self.s, Word(), False
        while self.i < len(s):
            c = s[self.i]
            if c == "\\":
                word.add(s[self.i + 1 : self.i + 2].replace("\n", ""))
                self.i += 2
            elif c == "'" or s.startswith("$'", self.i):
                start = self.i + (1 if c == "'" else 2)
                end = start
                while end < len(s) and s[end] != "'":
                    end += 2 if c == "$" and s[end] == "\\" else 1
                if end >= len(s):
                    raise Unreadable("a quote without end")
                text = s[start:end]
                if c == "$":
                    text = re.sub(r"\\(x[0-9a-fA-F]{1,2}|[0-7]{1,3}|u[0-9a-fA-F]{1,4}|.)", _escaped, text, flags=re.S)
                word.add(text)
                word.quoted = True
                self.i = end + 1
            elif c == '"':
                word.quoted = True
                self.i += 1
                while self.i < len(s) and s[self.i] != '"':
                    if s[self.i] == "\\":
                        word.add(s[self.i + 1 : self.i + 2] if s[self.i + 1 : self.i + 2] in ('"', "\\", "$", "`") else s[self.i : self.i + 2])
                        self.i += 2
                    elif s[self.i] in "$`":
                        self.expansion(word)
                    else:
                        word.add(s[self.i])
                        self.i += 1
                if self.i >= len(s):
                    raise Unreadable("a quote without end")
                self.i += 1
            elif c in "$`":
                self.expansion(word)
            elif c == "{" and (m := re.compile(r"\{[^\s{}]*(,|\.\.)[^\s{}]*\}").match(s, self.i)) and not word.variables:
                braced = True
                word.add("\0" + m.group()[1:-1] + "\1")
                self.i = m.end()
            elif c in " \t\r\n;|&()<>":
                break
            else:
                word.glob |= c in "*?["
                word.add(c)
                self.i += 1
        return _braces(word) if braced else [word]


def _escaped(m: re.Match) -> str:
    x = m.group(1)
    if x[0] in "xu" and len(x) > 1:
        return chr(int(x[1:], 16))
    if x[0] in "01234567":
        return chr(int(x, 8) & 255)
    return {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "e": "\x1b", "f": "\f", "v": "\v"}.get(x, x)


def _range(a: str, b: str) -> list[str]:
    """What {a..b} stands for; too many words are as good as their number."""
    number = a.lstrip("-").isdigit() and b.lstrip("-").isdigit()
    x, y = (int(a), int(b)) if number else (ord(a[-1]), ord(b[-1]))
    if abs(x - y) > WORDS:
        raise Unreadable("too many words")
    return [str(i) if number else chr(i) for i in (range(x, y + 1) if x <= y else range(x, y - 1, -1))]


def _braces(word: Word) -> list[Word]:
    texts = [word.text]
    while any("\0" in t for t in texts):
        out = []
        for t in texts:
            m = re.search("\0([^\0\1]*)\1", t)
            if m is None:
                out.append(t)
                continue
            span = re.fullmatch(r"(-?[0-9]+|[A-Za-z])\.\.(-?[0-9]+|[A-Za-z])(\.\.-?[0-9]+)?", m.group(1))
            parts = m.group(1).split(",") if not span else _range(span.group(1), span.group(2))
            out += [t[: m.start()] + p + t[m.end() :] for p in parts]
        if len(out) > WORDS:
            raise Unreadable("too many words")
        texts = out
    return [Word(t, list(word.variables), word.computed, word.glob, word.quoted) for t in texts]


def commands(script: str, depth: int = 0) -> list[Command]:
    """The simple commands of a script, those inside substitutions too; Unreadable if it can't be read to its end."""
    return Reader(script, depth).read()
