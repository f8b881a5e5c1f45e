"""One pass over a source text: its types, methods, and uses of names, told by a stack of open brackets (and, in Python, of indents).

This is the only part of the library that reads source text sign by sign. It is linear in the text, takes one file at a time and knows nothing of
repositories: everything that relates files is done on the tables made from it."""

from __future__ import annotations

import re
from bisect import bisect_left

QUOTED = r'"""[\s\S]*?(?:"""|\Z)|"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?'
REST = r"|(?P<word>@?[A-Za-z_$][\w$]*)|(?P<sign>=>|->|\?\.|[{}()\[\];,.=<>:])|(?P<line>\n)"
BRACES = re.compile(rf"(?P<skip>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<text>{QUOTED}|`(?:\\.|[^`\\])*`?){REST}")
INDENT = re.compile(rf"(?P<skip>#[^\n]*)|(?P<text>'''[\s\S]*?(?:'''|\Z)|{QUOTED}){REST}")

#: Languages, words that no method is named and no call calls, words that make what follows no declaration, and words that may stand before one.
JVM, SCRIPT = ("java", "kt", "kts", "cs"), ("js", "jsx", "mjs", "ts", "tsx", "vue")
LANGUAGES = (*JVM, *SCRIPT, "go", "py")
KEYWORDS = {
    "if", "for", "while", "switch", "catch", "return", "new", "throw", "else", "do", "try", "synchronized", "function", "super", "this", "typeof", "sizeof", "async", "await", "yield", "require", "import",
    "class", "def", "func", "fun", "when", "using", "lock", "foreach", "fixed", "with", "elif", "assert", "del", "not", "and", "or", "in", "is", "lambda", "print",
}
TYPES = {"class", "interface", "enum", "record", "object", "struct"}
BEFORE_SCRIPT = {"export", "default", "async", "function", "public", "private", "protected", "static", "override", "get", "set", "abstract", "readonly"}
DECLARES = {"const", "let", "var"}
VISIBILITY = {"public", "protected", "private", "internal"}
#: Signs and words with which a statement goes on in the next line, and signs after which it does.
GOES_ON = {"{", ")", "]", "extends", "implements", "throws", "where", ":", "=>", "->", ",", ".", "?.", "=", "<", ">"}
IS_OPEN = {"=", "=>", "->", ",", ".", "<", ":"}


def strip_comments(content: str | None, ext: str) -> str:
    """The text with comments as blanks; literals, line ends and offsets stay."""
    blank = lambda m: re.sub(r"[^\n]", " ", m.group()) if m.lastgroup == "skip" else m.group()
    return (INDENT if ext == "py" else BRACES).sub(blank, content or "")


class Item:
    """A word (dotted names are one), sign, literal or group of brackets of a statement's head. use: the place of what it uses, if it uses a name."""

    __slots__ = ("kind", "text", "start", "end", "line", "use")

    def __init__(self, kind, text, start, end, line, use=-1):
        self.kind, self.text, self.start, self.end, self.line, self.use = kind, text, start, end, line, use


class Level:
    """An open bracket, a body without one (=) or an indented block (i): the head that it stands in, and what it declares."""

    __slots__ = ("sign", "head", "start", "use", "declared", "indent", "attribute")

    def __init__(self, sign, head, start, use=-1, declared=None, indent=0, attribute=False):
        self.sign, self.head, self.start, self.use, self.declared, self.indent, self.attribute = sign, head, start, use, declared, indent, attribute


class Scan:
    """types, methods and uses of a text as dictionaries, in the order in which they begin."""

    def __init__(self, content: str | None, ext: str, named: frozenset = frozenset()):
        self.text, self.ext, self.named = content or "", ext, named
        self.types: list[dict] = []
        self.methods: list[dict] = []
        self.uses: list[dict] = []
        self.levels: list[Level] = []
        self.head: list[Item] = []
        self.line, self.end, self.last, self.arrow = 1, 0, 1, False
        self._read()
        while self.levels:
            self._leave(self.levels[-1])
        for u in self.uses:
            u.setdefault("last", u["line"])
        self._look_ahead()

    def _read(self) -> None:
        begins, broke = 0, True
        python = self.ext == "py"
        for m in (INDENT if python else BRACES).finditer(self.text):
            kind, t = m.lastgroup, m.group()
            if kind == "line":
                self.line += 1
                begins, broke = m.end(), True
                continue
            if kind == "skip":
                self.line += t.count("\n")
                continue
            if broke:
                broke = False
                self._new_line(t, m.start() - begins)
            if self.arrow and t != "{":
                self._enter_body(m.start())
            self.arrow = False
            getattr(self, "_" + kind)(t, m.start(), m.end())
            self.line += t.count("\n") if kind == "text" else 0
            self.end, self.last = m.end(), self.line

    def _top(self) -> str:
        return self.levels[-1].sign if self.levels else "{"

    def _new_line(self, first: str, indent: int) -> None:
        """A statement ends with its line, unless a bracket is open or one of both sides says otherwise."""
        if self._top() in "([":
            return
        if self.ext == "py":
            while self.levels and self.levels[-1].sign == "i" and self.levels[-1].indent >= indent:
                self._leave(self.levels[-1])
            self.head, self.indent = [], indent
        elif self.head and first not in GOES_ON and self.head[-1].text not in IS_OPEN:
            while self._top() == "=":
                self._leave(self.levels[-1])
            self.head = []

    def _word(self, t: str, start: int, end: int) -> None:
        h = self.head
        if len(h) > 1 and h[-1].text == "." and h[-2].kind == "word" and h[-2].text[-1:] != ">":
            h.pop()
            w = h[-1]
            w.text, w.end = f"{w.text}.{t}", end
            if w.use >= 0:
                self.uses[w.use].update(self._names(w.text))
            return
        h.append(w := Item("word", t, start, end, self.line))
        if t[0] == "@" or (self._top() == "[" and self.levels[-1].attribute and len(h) == 1):
            self._use(w)

    def _text(self, t: str, start: int, end: int) -> None:
        self.head.append(Item("text", "", start, end, self.line))

    def _names(self, dotted: str) -> dict:
        owner, _, name = dotted.lstrip("@").rpartition(".")
        return {"owner": owner, "name": name}

    def _use(self, w: Item) -> None:
        mark = "@" if w.text[0] == "@" else "[" if self._top() == "[" and self.levels[-1].attribute else ""
        w.use = len(self.uses)
        method = next((x.declared for x in reversed(self.levels) if x.declared and "visibility" in x.declared), None)
        self.uses.append({**self._names(w.text), "mark": mark, "line": w.line, "start": w.start, "end": w.end, "type": self._owner(), "method": method, "args": None, "declares": False, "field": self._assigned(w)})

    def _assigned(self, w: Item) -> str | None:
        """The name on the left, where the word stands on the right of an assignment."""
        at = next((i for i, x in enumerate(self.head) if x.text == "=" and x.kind == "sign"), None)
        words = [x.text for x in self.head[:at] if x.kind == "word" and x.text not in DECLARES and x.text not in BEFORE_SCRIPT] if at is not None and w.start > self.head[at].start else []
        return (words[-1] if self.ext in ("java", "cs", "go") else words[0]) if words else None

    def _owner(self) -> str:
        return next((x.declared["name"] for x in reversed(self.levels) if x.declared and "visibility" not in x.declared), "")

    def _sign(self, t: str, start: int, end: int) -> None:
        if t in "([":
            self._open(t, start)
        elif t in ")]":
            self._close(t, end)
        elif t == "{":
            self._enter(Level("{", None, start, declared=None if self.ext == "py" or self._top() == "[" else self._declare(start)))
        elif t == "}":
            if any(x.sign == "{" for x in self.levels):
                while True:
                    level = self.levels[-1]
                    self.end, self.last = end, self.line
                    self._leave(level)
                    if level.sign == "{":
                        break
                self.head = []
        elif t == ";":
            while self._top() == "=":
                self._leave(self.levels[-1])
            self.head = []
        elif t == "," and self._top() in "([":
            self.head = []
        else:
            self.head.append(Item("sign", "." if t == "?." else t, start, end, self.line))
            self._after_sign(t, start)

    def _after_sign(self, t: str, start: int) -> None:
        h = self.head
        if self.ext == "py":
            if t == ":" and self._top() in "{i" and h[0].kind == "word" and h[0].text in ("class", "def", "async"):
                declared = self._declare(start)
                if declared:
                    self._enter(Level("i", None, start, declared=declared, indent=self.indent))
        elif t == "=>" and self._top() in "{=" and (self.ext == "cs" or self.ext in SCRIPT and h[0].text in {*DECLARES, "export"} and any(x.text == "=" for x in h)):
            self.arrow = True
        elif t == "=" and self.ext in ("kt", "kts") and self._top() == "{" and any(x.text == "fun" for x in h) and sum(x.text == "=" for x in h) == 1:
            self._enter_body(start)

    def _enter(self, level: Level) -> None:
        level.head, self.head = self.head, []
        self.levels.append(level)

    def _enter_body(self, start: int) -> None:
        """The body of a method that is an expression."""
        self.arrow = False
        declared = self._declare(start)
        if declared:
            self._enter(Level("=", None, start, declared=declared))

    def _leave(self, level: Level) -> None:
        self.levels.pop()
        self.head = level.head
        if level.declared:
            level.declared.update(end=self.end, last=self.last)

    def _named(self) -> Item | None:
        """The word right before a bracket, type arguments between them left out."""
        i, depth = len(self.head) - 1, 0
        while i >= 0 and (depth or self.head[i].text == ">"):
            depth += (self.head[i].text == ">") - (self.head[i].text == "<")
            i -= 1
        return self.head[i] if i >= 0 and self.head[i].kind == "word" else None

    def _open(self, t: str, start: int) -> None:
        use = -1
        if t == "(" and (w := self._named()):
            if w.use < 0 and w.text.rpartition(".")[2] not in KEYWORDS:
                if w.text == self.head[-1].text or len(self.head) > 1:
                    self._use(w)
            use = w.use
        attribute = t == "[" and self.ext == "cs" and not self.head
        self._enter(Level(t, None, start, use=use, attribute=attribute))

    def _close(self, t: str, end: int) -> None:
        sign = "(" if t == ")" else "["
        if not any(x.sign == sign for x in self.levels[-2:]) and self._top() != sign:
            return
        while self._top() != sign:
            self.end, self.last = end, self.line
            self._leave(self.levels[-1])
        level = self.levels.pop()
        self.head = level.head
        if level.use >= 0:
            u = self.uses[level.use]
            u.update(end=end, last=self.line)
            if u["name"] in self.named:
                u["args"] = self.text[level.start + 1 : end - 1]
        if sign == "(":
            self.head.append(Item("group", "()", level.start, end, self.line, level.use))
        elif not level.attribute:
            self.head.append(Item("sign", "]", end - 1, end, self.line))

    # what a head declares

    def _declare(self, start: int) -> dict | None:
        return self._type(start) or self._method(start)

    def _type(self, start: int) -> dict | None:
        h = self.head
        at = next((i for i in range(len(h) - 2, -1, -1) if h[i].text in TYPES and h[i].kind == h[i + 1].kind == "word" and h[i + 1].text not in TYPES), None)
        if at is None or (self.ext == "py" and h[at].text != "class"):
            return None
        declared = {"name": h[at + 1].text, "kind": h[at].text, "line": h[at].line, "start": h[0].start, "at": h[at + 1].start, "body": self.line, **self._parents(h[at + 2 :]), "outer": self._owner()}
        for x in h:
            if x.use >= 0 and self.uses[x.use]["mark"] == "":
                self.uses[x.use]["declares"] = True
        self.types.append(declared)
        return declared

    def _parents(self, tail: list[Item]) -> dict:
        """Names behind extends, implements or a colon, and between the brackets of a Python class; what stands in brackets of any other kind is left out."""
        out, into, depth = {"extends": [], "implements": []}, None, 0
        for i, x in enumerate(tail):
            depth += (x.text == "<") - (x.text == ">")
            if x.kind == "group" and self.ext == "py" and i == 0:
                for part in self.text[x.start + 1 : x.end - 1].split(","):
                    if re.fullmatch(r"\s*[\w.]+\s*", part):
                        out["extends"].append(part.strip())
            elif x.text in out and depth == 0:
                into = out[x.text]
            elif x.text == ":" and depth == 0 and into is None:
                into = out["extends"]
            elif x.kind == "word" and depth == 0 and into is not None and x.text != "where" and (tail[i - 1].text in (",", ":", "extends", "implements")):
                into.append(x.text)
        return out

    def _method(self, start: int) -> dict | None:
        h, ext = self.head, self.ext
        if ext in SCRIPT and h and h[-1].text == "=>":
            at = next((i for i, x in enumerate(h[:-1]) if x.text in DECLARES), None)
            if at is None or not any(x.text == "=" for x in h) or h[at + 1].kind != "word":
                return None
            return self._add(h[at + 1].text, h[at + 1], "module")
        for i, g in enumerate(h):
            if g.text == "=" and not g.kind == "text":
                return None
            if g.kind != "group" or (g.use >= 0 and self.uses[g.use]["mark"]):
                continue
            before = [x.text for x in h[:i] if x.kind == "word" and x.text[0] != "@"]
            if g.use < 0:
                if ext == "go" and before == ["func"]:
                    continue  # the receiver
                return None
            u = self.uses[g.use]
            w = next(x for x in reversed(h[:i]) if x.use == g.use)
            before = before[: before.index(w.text)] if w.text in before else before
            if u["owner"] or (i > 1 and h[h.index(w) - 1].text == "." and h.index(w)) or set(before) & (KEYWORDS - {"def", "func", "fun", "function", "async"}) or "object" in before:
                return None
            if ext in SCRIPT and (set(before) - BEFORE_SCRIPT or ("function" not in before and self._top() != "{") or ("function" not in before and not self._owner())):
                return None
            if (ext in ("kt", "kts") and "fun" not in before) or (ext == "go" and "func" not in before) or (ext == "py" and "def" not in before):
                return None
            if ext in ("java", "cs") and not before and u["name"] != self._owner():
                return None
            u["declares"] = True
            return self._add(u["name"], w, self._seen(before, u["name"]))
        return None

    def _seen(self, before: list[str], name: str) -> str:
        said = next((x for x in before if x in VISIBILITY), None)
        if self.ext == "py":
            return "private" if name.startswith("_") else "public"
        if self.ext == "go":
            return "public" if name[:1].isupper() else "private"
        return said or ("package" if self.ext in JVM else "module" if "function" in before else "unknown")

    def _add(self, name: str, w: Item, visibility: str) -> dict:
        declared = {"name": name, "line": w.line, "start": self.head[0].start, "at": w.start, "body": self.line, "visibility": visibility, "owner": self._owner()}
        self.methods.append(declared)
        return declared

    def _look_ahead(self) -> None:
        """For each use the next method at or after its line; for annotations the next declaration too, and the words that they stand before."""
        self.methods.sort(key=lambda m: (m["line"], m["start"]))
        lines = [m["line"] for m in self.methods]
        ahead = sorted([(t["at"], "type", t["name"]) for t in self.types] + [(m["at"], "method", m["name"]) for m in self.methods])
        places, follow = [x[0] for x in ahead], None
        clean = strip_comments(self.text, self.ext) if any(u["mark"] and u["name"] in self.named for u in self.uses) else None
        for u in reversed(self.uses):
            k = bisect_left(lines, u["line"])
            u["next_method"] = self.methods[k]["name"] if k < len(lines) else None
            u["ahead"] = u["ahead_name"] = u["after"] = None
            if not u["mark"]:
                continue
            i = bisect_left(places, u["end"])
            if i < len(ahead):
                u["ahead"], u["ahead_name"] = ahead[i][1:]
            if clean is not None:
                alone = follow is None or clean[u["end"] : follow["start"]].strip(" \t\r\n]")
                u["after"] = re.match(r"[\s\]]*([^;{}=()\n]*)", clean[u["end"] : u["end"] + 400]).group(1).strip() if alone else follow["after"]
                follow = u
