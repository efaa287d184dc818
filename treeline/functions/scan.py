"""Function spans and decisions of one file, read from its masked text in one pass.

Masked text has no comments and empty literals. The scan keeps running bracket
depths over the whole text, so headers may span lines and nest without limits.
A function is ``(name or None, start line, end line, complexity)``; nested ones
count on their own and in the outer one.
"""

from __future__ import annotations

import re
from typing import NamedTuple

Span = tuple[str | None, int, int, int]

_PYTHON = re.compile(r"\\\n|\n\s*|[()\[\]{}:;]|[^\W\d]\w*|\d\w*|[^\s\w]")
_BRACES = re.compile(r"\n|=>|->|&&|\|\||\?\?=?|\?\.(?!\d)|[{}()\[\];,:?@]|[\w$#]+|[^\s\w]")
_NEXT = re.compile(r"\s*+(.?)", re.S)
_BODILESS = re.compile(r"\s*+(?:throws\b[\w$.,\s]*+)?;")
_OPENING, _CLOSING = "([{", ")]}"

_STATEMENT_WORDS = {"if", "elif", "for", "while", "except", "finally"}
_BRACE_DECISIONS = {"if", "else", "catch", "finally", "switch", "&&", "||"}
_SCRIPT_MODIFIERS = {
    "async", "static", "get", "set", "public", "private", "protected", "readonly", "override", "abstract", "*",
}
# words that may stand where a method's name or type would
_NO_NAME = {
    "if", "for", "while", "switch", "catch", "function", "return", "new", "throw", "else", "do", "try", "assert",
    "case", "await", "yield", "with", "synchronized", "package", "import", "typeof", "super", "class", "interface",
    "enum", "record", "instanceof", "delete", "in", "of",
}
_NO_TYPE = _NO_NAME - {"synchronized"}
_GOES_ON = set(".?:&|+-*/%=<>^,)]}") | {"&&", "||", "??", "??=", "?.", "=>", "instanceof", "in", "of"}


def python_functions(text: str) -> list[Span]:
    """A function ends before the next statement that is indented no deeper than its header."""
    found: list[list] = []
    open_: list[tuple[int, int]] = []  # indent and number of the functions around
    line, last_line, depth, decisions = 1, 1, 0, 0
    indent, fresh, begins, naming = 0, True, True, -1

    def close(upto: int) -> None:
        while open_ and open_[-1][0] >= upto:
            number = open_.pop()[1]
            found[number][2], found[number][3] = last_line, decisions - found[number][3] + 1

    first = re.match(r"\s*", text).group()
    line += first.count("\n")
    indent = len(first.rpartition("\n")[2])
    for token in _PYTHON.finditer(text, len(first)):
        word = token.group()
        if word[0] == "\n":
            line += word.count("\n")
            if depth == 0:
                indent, fresh, begins = len(word.rpartition("\n")[2]), True, True
            continue
        if word == "\\\n":
            line += 1
            continue
        if fresh:
            close(indent)
            fresh = False
        last_line = line
        if naming >= 0:
            found[naming][0], naming = word, -1
        elif word in _OPENING:
            depth += 1
            begins = False
        elif word in _CLOSING:
            depth = max(0, depth - 1)
            begins = False
        elif word in ("and", "or", "else"):
            decisions += 1
            begins = False
        elif word in (":", ";"):
            begins = depth == 0
        elif begins and word in _STATEMENT_WORDS:
            decisions += 1
            begins = False
        elif begins and word == "def":
            naming = len(found)
            found.append([None, line, line, decisions])
            open_.append((indent, naming))
            begins = False
        elif word != "async":
            begins = False
    close(-1)
    return [tuple(f) for f in found]


class _Header(NamedTuple):
    name: str | None
    line: int
    seen: int  # decisions before it


class _Braces:
    """State of one scan over a language with braces."""

    def __init__(self, java: bool):
        self.java = java
        self.found: list[list] = []
        self.decisions = 0
        self.brackets: list[list] = []  # character, line, decisions, header or role
        self.statement: list[tuple[str, int]] = []  # tokens since the statement began, while it may declare
        self.spoiled = False  # it can no longer be a declaration
        self.ready: _Header | None = None  # a header that waits for its body
        self.typed = False  # a return type may follow the header's arguments
        self.arrows: list[tuple[int, int]] = []  # expression arrows: depth and number
        self.loose_do: list[int] = []  # depths of do without braces
        self.ends_do = False

    def begin(self, header: _Header) -> int:
        self.found.append([header.name, header.line, header.line, header.seen])
        return len(self.found) - 1

    def end(self, number: int, line: int) -> None:
        entry = self.found[number]
        entry[2], entry[3] = line, self.decisions - entry[3] + 1

    def end_arrows(self, line: int, depth: int) -> None:
        while self.arrows and self.arrows[-1][0] >= depth:
            self.end(self.arrows.pop()[1], line)

    def restart(self) -> None:
        self.statement, self.spoiled = [], False

    def note(self, word: str, line: int) -> None:
        """Take a token into the statement; one that no declaration has before its name spoils it."""
        if self.spoiled or (self.brackets and self.brackets[-1][0] != "{"):
            return
        if self.statement and not self.java and self.statement[-1][0] not in _SCRIPT_MODIFIERS:
            self.spoiled = True
        elif self.java and not re.fullmatch(r"[\w$]+|[.<>\[\],?&@]", word):
            self.spoiled = True
        else:
            self.statement.append((word, line))

    def declares(self, name: str) -> tuple[int, bool] | None:
        """Start line and whether a type stands before, if ``name (`` may begin a declaration."""
        if not re.fullmatch(r"#?[A-Za-z_$][\w$]*", name) or name in _NO_NAME:
            return None
        before = self.statement[:-1]
        while before and before[0][0] == "@":  # annotations
            before = before[2:]
            while before and before[0][0] == ".":
                before = before[2:]
        words = [w for w, _ in before]
        if any(w in _NO_TYPE for w in words):
            return None
        if self.java and words and not re.fullmatch(r"[\w$]+|[>\]]", words[-1]):
            return None
        return (before or self.statement[-1:])[0][1], bool(before)


def _scan_braces(text: str, java: bool) -> list[Span]:
    s = _Braces(java)
    line, before, before_line = 1, "", 1
    closed: list | None = None  # the bracket pair that ended just now, or before a return type
    wait_body = False  # the last token was =>
    pending_break = False
    function_name: tuple[int, str | None] | None = None
    for match in _BRACES.finditer(text):
        word = match.group()
        if word == "\n":
            line += 1
            pending_break = True
            continue
        depth = len(s.brackets)
        if pending_break:
            pending_break = False
            if s.arrows and s.arrows[-1][0] == depth and word not in _GOES_ON and before not in _GOES_ON - set(")]}"):
                s.end_arrows(before_line, depth)
            if not java and s.ready is None and (not s.brackets or s.brackets[-1][0] == "{"):
                s.restart()  # a line may begin a method
        if wait_body:
            wait_body = False
            if word != "{":
                s.arrows.append((depth, s.begin(s.ready)))
                s.ready = None
        if s.ready is not None and word not in ("{", "=>") and not (s.typed and word not in (";", "}")):
            s.ready = None
        if s.ready is not None and word == ";":
            s.ready = None
        if function_name is not None and word != "*":
            if word == "(":
                s.brackets.append(["(", line, s.decisions, ("header", function_name[1], function_name[0])])
                closed, before, before_line, function_name = None, word, line, None
                continue
            function_name = (function_name[0], word) if re.fullmatch(r"[\w$]+", word) else None
        if word == "(":
            role = ("for", depth) if before == "for" else None
            if role is None and not s.spoiled and s.statement and s.statement[-1][0] == before and (
                not s.brackets or s.brackets[-1][0] == "{"
            ):
                if len(s.statement) > 1 and s.statement[-2][0] == "@":
                    role = ("annotation",)
                elif found := s.declares(before):
                    role = ("method", before, *found)
            if not s.brackets or s.brackets[-1][0] == "{":
                s.spoiled = role != ("annotation",)
            s.brackets.append(["(", line, s.decisions, role])
        elif word in "[{":
            role = None
            if word == "{":
                if s.ready is not None:
                    role = ("body", s.begin(s.ready))
                elif before == "do":
                    role = ("do",)
                s.ready, s.typed = None, False
            s.brackets.append([word, line, s.decisions, role])
            if word == "{":
                s.restart()
        elif word in _CLOSING:
            s.end_arrows(before_line, depth)
            pair = s.brackets.pop() if s.brackets else None
            role = pair[3] if pair else None
            if word == "}":
                s.restart()
                s.ends_do = bool(role) and role[0] == "do"
                if role and role[0] == "body":
                    s.end(role[1], line)
            elif word == ")" and role:
                if role[0] == "header" and role[1] is not None:
                    s.ready, s.typed = _Header(role[1], role[2], pair[2]), True
                elif role[0] == "method":
                    s.ready, s.typed = _Header(role[1], role[2], pair[2]), True
                    if java and role[3] and _BODILESS.match(text, match.end()):
                        number = s.begin(s.ready)
                        s.end(number, line)
                        s.found[number][3], s.ready = 1, None
                elif role[0] == "annotation":
                    s.restart()
            closed = pair if word == ")" else None
            before, before_line = word, line
            continue
        elif word == "=>":
            name = before if re.fullmatch(r"[A-Za-z_$][\w$]*", before) and closed is None else None
            start, seen = (closed[1], closed[2]) if closed else (before_line, s.decisions)
            s.ready, s.typed, wait_body = _Header(name, start, seen), False, True
        elif word == ";":
            s.end_arrows(before_line, depth)
            s.restart()
            if s.brackets and s.brackets[-1][3] and s.brackets[-1][3][0] == "for" and len(s.brackets[-1][3]) == 2:
                s.brackets[-1][3] = ("for",)  # counted once
                s.decisions += 1
        elif word == ",":
            s.end_arrows(before_line, depth)
            if s.brackets and s.brackets[-1][0] == "{" and not java:
                s.restart()
            else:
                s.note(word, line)
        elif word in _BRACE_DECISIONS:
            s.decisions += 1
            s.note(word, line)
        elif word == "while":
            if s.ends_do:
                pass
            elif s.loose_do and s.loose_do[-1] == depth:
                s.loose_do.pop()
            else:
                s.decisions += 1
            s.note(word, line)
        elif word == "?":
            following = _NEXT.match(text, match.end()).group(1)
            if before not in ("?", "<", ",", "(") and following not in set(":>,)=;"):
                s.decisions += 1
            s.note(word, line)
        elif word == ":":
            if not (closed is not None and before == ")"):
                s.restart()
        else:
            if word == "do" and _NEXT.match(text, match.end()).group(1) != "{":
                s.loose_do.append(depth)
            elif word == "function" and not java:
                function_name = (line, None)
            s.note(word, line)
        if word != "}":
            s.ends_do = False
        if closed is not None and not (before == ")" and word == ":") and not (
            before != ")" and re.fullmatch(r"[\w$]+|[.<>|&\[\],]", word)
        ):
            closed = None
        before, before_line = word, line
    s.end_arrows(before_line, 0)
    for pair in reversed(s.brackets):
        if pair[3] and pair[3][0] == "body":
            s.end(pair[3][1], before_line)
    return [tuple(f) for f in s.found]


def functions_in(language: str, text: str) -> list[Span]:
    """The functions of a masked text, in the order of their headers."""
    found = python_functions(text) if language == "python" else _scan_braces(text, language == "java")
    return sorted(found, key=lambda f: f[1])
