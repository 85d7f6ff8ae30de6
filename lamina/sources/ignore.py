"""Ignore rules: lines of ignore files as patterns, their order of precedence, and both as a walk and a table need them.

A line is a glob relative to its file's folder. ``*`` and ``?`` stay within a name, ``**`` between slashes spans folders, ``[...]``
is a class, a backslash takes the next sign literally, ``!`` takes back in, a slash at the end means folders only, a
slash elsewhere ties the pattern to the folder; without one it fits names at any depth. Of the lines that fit, the last
decides. What lies below an ignored folder is ignored whatever later lines say.

The lines of a file become one expression, the last line first, so that what it meets first decides. A folder is written with a
sign at its end that no name holds. The expressions are those of both Python and Java.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The files' names.
PLAIN, GIT, EXCLUDE = ".ignore", ".gitignore", "info/exclude"
NAME = r"[^/\x00]"
#: What stands behind a folder's path: no name holds it, so it can't be taken for part of one.
FOLDER = "\0"


def _literal(c: str) -> str:
    return c if c.isalnum() or c == "_" or not c.isascii() else "\\" + c


def _class(glob: str, at: int) -> tuple[str, int] | None:
    """The class that begins at ``at`` and the place behind it; None without an end or with a range that runs backwards."""
    end = at + 1
    negated = glob[end : end + 1] in ("!", "^")
    end += negated
    signs = []
    while end < len(glob) and (glob[end] != "]" or not signs):
        if glob[end] == "\\" and end + 1 < len(glob):
            end += 1
        low = high = glob[end]
        if glob[end + 1 : end + 2] == "-" and glob[end + 2 : end + 3] not in ("", "]"):
            high = glob[end + 2]
            end += 2
        if high < low:
            return None
        signs.append(_literal(low) if low == high else f"{_literal(low)}-{_literal(high)}")
        end += 1
    if end >= len(glob):
        return None
    return f"(?![/\\x00])[{'^' * negated}{''.join(signs)}]", end + 1


def expression(glob: str, anchored: bool) -> str | None:
    """What a path without a slash at its end must match wholly; None for a glob that can't be read, which fits nothing."""
    out, at = [] if anchored else ["(?:(?s:.*)/)?"], 0
    while at < len(glob):
        c = glob[at]
        if glob.startswith("**", at) and (at == 0 or glob[at - 1] == "/"):
            if glob.startswith("**/", at):
                out.append("(?:(?s:.*)/)?")
                at += 3
                continue
            if at + 2 == len(glob):
                out.append("(?s:.+)")
                at += 2
                continue
        if c == "*":
            while glob[at : at + 1] == "*":
                at += 1
            out.append(f"{NAME}*")
            continue
        if c == "?":
            out.append(NAME)
        elif c == "[":
            if (found := _class(glob, at)) is None:
                return None
            out.append(found[0])
            at = found[1]
            continue
        elif c == "\\":
            at += 1
            if at == len(glob):
                return None
            out.append(_literal(glob[at]))
        else:
            out.append(_literal(c))
        at += 1
    return "".join(out)


@dataclass(frozen=True)
class Rule:
    """``expression`` fits paths relative to the file's folder, folders with FOLDER at their end; ``keeps`` takes them back in."""

    expression: str
    keeps: bool


def rule(line: str) -> Rule | None:
    """The rule of a line; None for blanks, comments and globs that can't be read."""
    text = line.rstrip("\r\n")
    while text.endswith(" ") and not text.endswith("\\ "):
        text = text[:-1]
    if not text or text.startswith("#"):
        return None
    keeps = text.startswith("!")
    text = text[keeps:]
    only_folders = text.endswith("/") and not text.endswith("\\/")
    text = text.rstrip("/") if only_folders else text
    anchored = "/" in text
    body = expression(text.removeprefix("/"), anchored) if text else None
    return None if body is None else Rule(body + (r"\x00" if only_folders else r"\x00?"), keeps)


@dataclass(frozen=True)
class Rules:
    """The rules of one file, in its order."""

    rules: tuple[Rule, ...]

    @classmethod
    def of(cls, lines: Iterable[str]) -> Rules:
        return cls(tuple(r for r in map(rule, lines) if r))

    @classmethod
    def read(cls, path: str) -> Rules | None:
        """None if there is no such file or nothing in it."""
        try:
            with open(path, encoding="utf-8", errors="surrogateescape") as f:
                found = cls.of(f)
        except OSError:
            return None
        return found if found.rules else None

    @cached_property
    def _automaton(self) -> re.Pattern:
        return re.compile("|".join(f"({r.expression})" for r in reversed(self.rules)))

    def verdict(self, path: str, is_folder: bool) -> bool | None:
        """True: ignored; False: taken back in; None: no line fits."""
        if not self.rules:
            return None
        found = self._automaton.fullmatch(path + FOLDER if is_folder else path)
        return None if found is None else not self.rules[len(self.rules) - found.lastindex].keeps


def ignored(path: Column, rules: Rules) -> Column:
    """Whether a file's path is ignored by the rules of the folder that paths are relative to, or lies below a folder that is."""

    def verdict(candidate: Column) -> Column:
        out = F.lit(False)
        for r in rules.rules:  # the last one that fits decides
            out = F.when(candidate.rlike(f"\\A(?:{r.expression})\\z"), F.lit(not r.keeps)).otherwise(out)
        return out

    names = F.split(path, "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(names)), lambda n: F.concat(F.array_join(F.slice(names, 1, n), "/"), F.when(n < F.size(names), FOLDER).otherwise("")))
    return F.exists(folders, verdict)


@dataclass(frozen=True)
class Level:
    """The ignore files of a folder; paths in them are relative to it."""

    folder: str
    plain: Rules | None
    git: Rules | None
    exclude: Rules | None
    has_git: bool
    is_repository: bool


@dataclass(frozen=True)
class Ignore:
    """Which rules hold in a walk: of .ignore files, and of what git ignores (.gitignore, info/exclude, a file for all)."""

    plain: bool = True
    git: bool = True
    require_git: bool = True
    everywhere: Rules | None = None

    def level(self, folder: str) -> Level:
        inside = os.path.join(folder, ".git")
        at = lambda use, *name: Rules.read(os.path.join(folder, *name)) if use else None
        return Level(folder, at(self.plain, PLAIN), at(self.git, GIT), at(self.git, ".git", EXCLUDE), os.path.exists(inside), os.path.isfile(inside) or os.path.exists(os.path.join(inside, "HEAD")))

    def levels_above(self, root: str) -> list[Level]:
        """The folders above ``root``, the topmost first."""
        out, folder = [], os.path.dirname(os.path.abspath(root))
        while True:
            out.append(self.level(folder))
            if os.path.dirname(folder) == folder:
                return out[::-1]
            folder = os.path.dirname(folder)

    def verdict(self, path: str, is_folder: bool, levels: list[Level]) -> bool:
        """Whether the path is ignored. Lines of .ignore files go before those of .gitignore, these before info/exclude, that before the file
        for all; among files of a kind the nearest goes first. A repository ends what the .gitignore files above it say; any .git, even an empty one,
        makes them hold."""
        found: dict[str, bool | None] = dict.fromkeys(("plain", "git", "exclude"))
        in_git, below_git = not self.require_git or any(x.has_git for x in levels), False
        for x in reversed(levels):
            rest = os.path.relpath(path, x.folder)
            for kind in found:
                rules = getattr(x, kind)
                if rules and found[kind] is None and (kind == "plain" or in_git and not below_git):
                    found[kind] = rules.verdict(rest, is_folder)
            below_git = below_git or x.is_repository
        if in_git and self.everywhere and levels:
            top = next((x.folder for x in reversed(levels) if x.has_git), levels[0].folder)
            found["everywhere"] = self.everywhere.verdict(os.path.relpath(path, top), is_folder)
        return next((x for x in found.values() if x is not None), False)


def global_file() -> str:
    """Where git keeps the ignore file for all repositories unless its settings name another."""
    return os.path.join(os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config"), "git", "ignore")
