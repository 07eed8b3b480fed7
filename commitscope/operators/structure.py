"""Structural analysis of source text: functions with their measures, constructs, documentation and clones.

Python is parsed with the standard ``ast`` module. Languages with braces are read by a scanner that blanks strings and
comments and matches brackets; it finds declarations by their shape. Everything returns plain rows, so the callers are
``mapInPandas`` bodies with one row a construct.
"""

from __future__ import annotations

import ast
import io
import keyword
import math
import re
import tokenize
from bisect import bisect_left
from dataclasses import dataclass, field
from hashlib import md5

from commitscope.functions.lines import classify

EXT = {
    "py": "Python", "pyi": "Python", "rs": "Rust", "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "java": "Java", "go": "Go",
    "kt": "Kotlin", "kts": "Kotlin", "dart": "Dart", "cpp": "C++", "cc": "C++", "cxx": "C++", "hpp": "C++", "h": "C++", "cs": "C#", "php": "PHP", "swift": "Swift", "scala": "Scala", "sc": "Scala", "rb": "Ruby", "sh": "Bash", "bash": "Bash",
}
METRIC = {"Python", "Rust", "TypeScript", "JavaScript", "Java", "Go", "Kotlin", "Dart"}


@dataclass
class Item:
    kind: str
    name: str
    start: int
    end: int
    enclosing: str | None = None
    params: int = 0
    cyclomatic: int = 1
    cognitive: int = 0
    exits: int = 0
    operators: list = field(default_factory=list)
    operands: list = field(default_factory=list)
    skeleton: str = ""
    public: bool = True
    documented: bool = False

    @property
    def qualified(self) -> str:
        if self.kind == "closure":
            return f"{self.enclosing}::<closure@{self.start}>" if self.enclosing else f"<closure@{self.start}>"
        return f"{self.enclosing}::{self.name}" if self.enclosing and self.kind in ("function", "method") else self.name

    @property
    def volume(self) -> float:
        n = len(set(self.operators)) + len(set(self.operands))
        return (len(self.operators) + len(self.operands)) * math.log2(n) if n > 1 else 0.0


def language(path: str) -> str | None:
    return EXT.get(path.rsplit(".", 1)[-1].lower())


_DECIDES = frozenset([ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.match_case])
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_NAMED = (*_FUNCTIONS, ast.ClassDef)
_NESTED = frozenset([*_FUNCTIONS, ast.Lambda])
_LITERALS = frozenset(["True", "False", "None"])
_ESCAPE = re.compile(r"\\(?:N\{[^}]*\}|x..|u....|U........|[0-7]{1,3}|.)", re.S)
_QUOTED = re.compile(r"""(?s)([A-Za-z]*)(\"{3}|'{3}|"|')(.*)\2\Z""")


def _tokens(text: str) -> list[tuple[tuple[int, int], str, bool]]:
    """(place, token, is an operand) of Python source: names and literals are operands, keywords and signs are not."""
    out = []
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type == tokenize.NAME:
                out.append((t.start, t.string, t.string in _LITERALS or not keyword.iskeyword(t.string)))
            elif t.type == tokenize.NUMBER:
                out.append((t.start, t.string, True))
            elif t.type == tokenize.STRING and (m := _QUOTED.match(t.string)):
                inner = _ESCAPE.findall(m[3]) if "\\" in m[3] and "r" not in m[1].lower() else [m[3]]
                out += [(t.start, x, True) for x in (m[1] + m[2], *inner, m[2]) if x.strip()]
            elif t.type == tokenize.OP:
                out.append((t.start, t.string, t.string == "..."))
            elif tokenize.tok_name[t.type].startswith(("FSTRING", "TSTRING")) and t.string.strip():
                out.append((t.start, t.string, True))
    except (tokenize.TokenError, IndentationError, SyntaxError):
        pass
    return out


def _children(node: ast.AST) -> list[ast.AST]:
    """The children of ``ast.iter_child_nodes``, as a list."""
    out = []
    for name in node._fields:
        x = getattr(node, name, None)
        if isinstance(x, list):
            out += [y for y in x if isinstance(y, ast.AST)]
        elif isinstance(x, ast.AST):
            out.append(x)
    return out


def _arguments(node: ast.AST) -> int:
    """Declared parameters; the bare signs that part them count as well."""
    a = node.args
    return len(a.posonlyargs) + bool(a.posonlyargs) + len(a.args) + len(a.kwonlyargs) + (a.vararg is not None or bool(a.kwonlyargs)) + (a.kwarg is not None)


def _measure_python(item: Item, node: ast.AST) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """Decisions, depth, exits and shape of a function without the functions inside it; returns where those stand.

    An ``elif`` is a decision inside its ``if``, beside the others. The walk keeps its own stack.
    """
    inner, shape = [], []
    outside = getattr(node, "decorator_list", [])
    cyclomatic, cognitive, exits = item.cyclomatic, item.cognitive, item.exits
    todo: list = [(kid, 0) for kid in reversed(_children(node)) if kid not in outside]
    while todo:
        kid, depth = todo.pop()
        if kid is None:
            shape.append(")")
            continue
        what = type(kid)
        if not what._fields:
            shape.append(f"({what.__name__})")
            continue
        if what in _NESTED:
            shape.append("<fn>")
            inner.append(((kid.lineno, kid.col_offset), (kid.end_lineno, kid.end_col_offset)))
            continue
        shape.append("(" + what.__name__)
        todo.append((None, 0))
        below = at = depth
        chained = None
        if what in _DECIDES:
            cyclomatic += 1
            cognitive += 1 + depth
            below = at = depth + 1
            # the next elif of a chain stands at the depth of the first
            if what is ast.If and len(kid.orelse) == 1 and type(kid.orelse[0]) is ast.If and kid.orelse[0].col_offset == kid.col_offset:
                chained = kid.orelse[0]
                at = depth if getattr(kid, "chained", False) else below
                chained.chained = True
        elif what is ast.Return:
            exits += 1
        kids = _children(kid)
        kids.reverse()
        todo += [(x, at if x is chained else below) for x in kids]
    item.cyclomatic, item.cognitive, item.exits = cyclomatic, cognitive, exits
    item.skeleton = "".join(shape)
    return inner


def _python(text: str, measured: bool = True) -> list[Item]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out: list[Item] = []
    found, lines = (_tokens(text), text.splitlines()) if measured else ([], [])
    places = [t[0] for t in found]

    def place(line: int, offset: int) -> tuple[int, int]:
        """Columns of the tree are bytes, those of tokens characters."""
        row = lines[line - 1] if line <= len(lines) else ""
        return line, offset if row.isascii() else len(row.encode("utf-8", "surrogatepass")[:offset].decode("utf-8", "ignore"))

    def measure(item: Item, node: ast.AST) -> None:
        if not measured:
            return
        inner = _measure_python(item, node)
        skip = sorted((place(*a), place(*b)) for a, b in inner)
        low, high = bisect_left(places, place(node.lineno, node.col_offset)), bisect_left(places, place(node.end_lineno, node.end_col_offset))
        k = low
        for a, b in [*skip, ((1 << 40, 0), (1 << 40, 0))]:
            end = min(high, bisect_left(places, a))
            for _, token, operand in found[k:end]:
                (item.operands if operand else item.operators).append(token)
            k = max(k, min(high, bisect_left(places, b)))

    todo: list = [(kid, None, False) for kid in reversed(_children(tree))]
    while todo:
        kid, inside, in_class = todo.pop()
        if isinstance(kid, _NAMED):
            what = "class" if isinstance(kid, ast.ClassDef) else "method" if in_class else "function"
            item = Item(what, kid.name, kid.lineno, kid.end_lineno or kid.lineno, None if what == "class" else inside)
            item.public, item.documented = not kid.name.startswith("_"), ast.get_docstring(kid) is not None
            if what != "class":
                item.params = _arguments(kid)
                measure(item, kid)
            inside, in_class = kid.name, what == "class"
            out.append(item)
        elif isinstance(kid, ast.Lambda):
            item = Item("closure", "", kid.lineno, kid.end_lineno or kid.lineno, inside, _arguments(kid))
            measure(item, kid)
            out.append(item)
        todo += [(x, inside, in_class) for x in reversed(_children(kid)) if x._fields]
    return out


_NOISE = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n]){0,40}'|`(?:\\.|[^`\\])*`""", re.S)
_HASH_NOISE = re.compile(r"""#[^\n]*|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'""", re.S)
_WORD = re.compile(r"[A-Za-z_$][\w$]*|\d[\w.]*|[^\s\w]")
_NOT_NAMES = frozenset("if for while switch catch return match loop else do try when function fn func new sizeof throw await yield in of unsafe async synchronized using lock foreach guard with".split())
_TYPES = {"class": "class", "struct": "struct", "enum": "enum", "trait": "trait", "interface": "interface", "protocol": "interface", "mod": "module", "namespace": "module", "module": "module", "object": "class", "mixin": "class", "extension": "class", "record": "class"}
_TYPE = re.compile(r"\b(class|struct|enum|trait|interface|protocol|mod|namespace|module|object|mixin|extension|record)\s+([A-Za-z_$][\w$]*)[^;{}()]*(?:\([^()]*\))?[^;{}()]*\{")
_IMPL = re.compile(r"\bimpl\b(?:\s*<[^{}]*?>)?\s+(?:[\w:<>, &']+?\s+for\s+)?([A-Za-z_]\w*)[^;{}]*\{")
_GO_TYPE = re.compile(r"\btype\s+([A-Za-z_]\w*)\s+(struct|interface)\s*\{")
_FUNC = {
    "Rust": re.compile(r"\bfn\s+([A-Za-z_]\w*)\s*(?:<[^{};()]*>)?\s*\(([^{};]*?)\)[^;{}]*\{"),
    "Go": re.compile(r"\bfunc\s+(?:\(\s*\w*\s*\*?\s*(?P<receiver>[\w\[\]]+)\s*\)\s*)?([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\(([^{};]*?)\)[^;{}\n]*\{"),
    "Kotlin": re.compile(r"\bfun\s+(?:<[^>]*>\s*)?(?:[\w.<>?]+\.)?([A-Za-z_]\w*)\s*\(([^{};]*?)\)[^;{}=\n]*\{"),
    "Swift": re.compile(r"\bfunc\s+([A-Za-z_]\w*)\s*(?:<[^{};()]*>)?\(([^{};]*?)\)[^;{}]*\{"),
    "Scala": re.compile(r"\bdef\s+([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?(?:\(([^{};]*?)\))?[^;{}\n]*\{"),
    "PHP": re.compile(r"\bfunction\s+&?([A-Za-z_]\w*)\s*\(([^{};]*?)\)[^;{}]*\{"),
    "Bash": re.compile(r"(?m)^\s*(?:function\s+)?([A-Za-z_][\w-]*)\s*\(()\s*\)\s*\{"),
}
_C_LIKE = re.compile(r"(?:\bfunction\s*\*?\s*)?(?<![.\w$])([A-Za-z_$~][\w$]*)\s*(?:<[^{};()]*>)?\(([^{};()]*(?:\([^()]*\)[^{};()]*)*)\)\s*(?:const|noexcept|override|final|async\*?|sync\*|throws\s+[\w., ]+|:\s*[^{};()=]+|\s)*\{")
_ARROW = re.compile(r"(?:\(([^(){};]*)\)|([A-Za-z_$][\w$]*))\s*(?::\s*[\w<>\[\]| ]+)?=>\s*\{?")
_RUST_CLOSURE = re.compile(r"(?<=[=(,\s])(?:move\s+)?\|([^|\n;{}]*)\|\s*\{?")
_DECISION = {
    "Rust": r"\b(?:if|while|for|loop)\b|=>|\?(?=[;.,)\s])", "Go": r"\b(?:if|for|case|default)\b", "Kotlin": r"\b(?:if|while|for|catch)\b|->",
    "Java": r"\b(?:if|while|for|case|default|catch)\b|\?(?!\s*[>,.])", "TypeScript": r"\b(?:if|while|for|case|catch)\b|\?(?![.?:,)])", "JavaScript": r"\b(?:if|while|for|case|catch)\b|\?(?![.?:,)])",
    "Dart": r"\b(?:if|while|for|case|catch)\b|\?(?![.?:,)>])",
}
_EXIT = {"Kotlin": r"\b(?:return|break|continue)\b", "Rust": r"\breturn\b|\?(?=[;.,)\s])"}


def _blank(text: str, language_name: str) -> str:
    noise = _HASH_NOISE if language_name in ("Ruby", "Bash") else _NOISE

    def gone(m: re.Match) -> str:
        if language_name == "Rust" and m[0][0] == "'" and len(m[0]) > 4 and "\\" not in m[0]:
            return m[0]  # lifetimes, not a character
        return re.sub(r"[^\n]", " ", m[0])

    return noise.sub(gone, text)


def _closing(text: str, at: int) -> int:
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.start()
    return len(text) - 1


def _count_params(inside: str | None) -> int:
    depth, n = 0, 1
    for c in inside or "":
        depth += (c in "(<[{") - (c in ")>]}")
        n += c == "," and not depth
    parts = (inside or "").strip().rstrip(",")
    return n - (inside or "").strip().endswith(",") if parts else 0


def _braces(text: str, lang: str, measured: bool = True) -> list[Item]:
    bare = _blank(text, lang)
    line_of = lambda at: bare.count("\n", 0, at) + 1
    spans: list[tuple[int, int, Item]] = []
    if lang == "Go":
        for m in _GO_TYPE.finditer(bare):
            spans.append((m.start(), _closing(bare, m.end() - 1), Item(m[2], m[1], 0, 0)))
    else:
        for m in _TYPE.finditer(bare):
            if lang == "Rust" and m[1] in ("class", "interface", "object", "module", "namespace", "record", "extension", "protocol"):
                continue
            kind = "enum" if re.search(r"\benum\s+$", bare[max(0, m.start() - 8) : m.start()]) else _TYPES[m[1]]
            spans.append((m.start(), _closing(bare, m.end() - 1), Item(kind, m[2], 0, 0)))
        if lang == "Rust":
            for m in _IMPL.finditer(bare):
                spans.append((m.start(), _closing(bare, m.end() - 1), Item("impl", m[1], 0, 0)))
    types = [s for s in spans if s[2].kind != "module"]
    for m in _FUNC.get(lang, _C_LIKE).finditer(bare):
        groups = [g for g in m.groups() if g is not None or len(m.groups()) == 2]
        name, args = (m[2], m[3]) if lang == "Go" else (groups[0], m[2] if len(m.groups()) > 1 else "")
        if name in _NOT_NAMES or any(s == m.start() for s, _, _ in spans):
            continue
        item = Item("function", name, 0, 0, params=_count_params(args))
        if lang == "Go" and m["receiver"]:
            item.kind, item.enclosing = "method", m["receiver"].split("[")[0]
        spans.append((m.start(1) if lang in ("Java", "C#", "C++", "Dart") else m.start(), _closing(bare, m.end() - 1), item))
    closures = _ARROW if lang in ("TypeScript", "JavaScript", "Dart") else _RUST_CLOSURE if lang == "Rust" else None
    for m in closures.finditer(bare) if closures else ():
        end = _closing(bare, m.end() - 1) if bare[m.end() - 1] == "{" else (bare.find("\n", m.end()) if "\n" in bare[m.end() :] else len(bare)) - 1
        spans.append((m.start(), end, Item("closure", "", 0, 0, params=_count_params(m[1]))))
    spans.sort(key=lambda s: (s[0], -s[1]))
    doc = text.split("\n")
    for start, end, item in spans:
        item.start, item.end = line_of(start), line_of(end)
        if item.kind in ("function", "closure") and item.enclosing is None:
            around = [t for s, e, t in types if s < start and end <= e]
            holders = [t for s, e, t in spans if t is not item and t.kind in ("function", "method") and s < start and end <= e]
            if around and item.kind == "function" and not holders:
                item.kind, item.enclosing = "method", around[-1].name
            elif holders or around:
                item.enclosing = (holders or around)[-1].name
        if measured and item.kind in ("function", "method", "closure"):
            own = list(bare[start : end + 1])
            for s, e, t in spans:
                if t is not item and t.kind in ("function", "method", "closure") and start < s and e <= end:
                    own[s - start : e + 1 - start] = [c if c == "\n" else " " for c in own[s - start : e + 1 - start]]
            _measure(item, "".join(own), lang)
        head = bare[bare.rfind("\n", 0, start) + 1 : start + 40]
        item.public = {
            "Rust": bool(re.search(r"\bpub\b", head)), "Go": item.name[:1].isupper(), "Java": "public" in head, "TypeScript": head.lstrip().startswith("export"), "JavaScript": head.lstrip().startswith("export"),
            "Kotlin": not re.search(r"\b(private|internal|protected)\b", head), "Dart": not item.name.startswith("_"),
        }.get(lang, True)
        above = next((x.strip() for x in reversed(doc[: item.start - 1]) if x.strip() and not x.strip().startswith(("#[", "@"))), "")
        item.documented = above.startswith("//") if lang == "Go" else above.endswith("*/") if lang not in ("Rust", "Dart") else above.startswith("///") or above.endswith("*/")
    return [item for _, _, item in spans]


def _measure(item: Item, own: str, lang: str) -> None:
    body = own[own.find("{") :] if "{" in own else own
    depth, nest = 0, []
    decide = re.compile(_DECISION.get(lang, _DECISION["Java"]) + r"|[{}]")
    pending = False
    for m in decide.finditer(body):
        if m[0] == "{":
            depth += 1
            nest.append(pending)
            pending = False
        elif m[0] == "}":
            nest = nest[:-1]
        else:
            item.cyclomatic += 1
            item.cognitive += 1 + sum(nest)
            pending = m[0] in ("if", "while", "for", "loop", "catch", "=>", "->")
    item.exits = len(re.findall(_EXIT.get(lang, r"\breturn\b"), body))
    tokens = _WORD.findall(own)
    item.operands = [t for t in tokens if t[0].isalnum() or t[0] in "_$"]
    item.operators = [t for t in tokens if not (t[0].isalnum() or t[0] in "_$")]
    item.skeleton = " ".join("_" if (t[0].isalnum() or t[0] in "_$") and t not in _NOT_NAMES else t for t in tokens)


_RUBY_OPEN = re.compile(r"^\s*(?:def\s+(self\.)?([\w?!=\[\]]+)|(class|module)\s+([A-Z]\w*)|(?:if|unless|while|until|case|begin|for)\b|.*\bdo\b(?:\s*\|[^|]*\|)?\s*$)")


def _ruby(text: str) -> list[Item]:
    out: list[Item] = []
    stack: list[Item | None] = []
    for k, raw in enumerate(_blank(text, "Ruby").split("\n"), 1):
        if m := _RUBY_OPEN.match(raw):
            held = next((s for s in reversed(stack) if s and s.kind in ("class", "module")), None)
            item = None
            if m[2]:
                item = Item("method" if held else "function", m[2], k, k, held.name if held else None)
            elif m[3]:
                item = Item(m[3], m[4], k, k)
            if item:
                out.append(item)
            if not re.search(r"\bend\s*$", raw):
                stack.append(item)
        elif re.match(r"^\s*end\b", raw) and stack and (item := stack.pop()):
            item.end = k
    return out


def items(path: str, text: str, measured: bool = True) -> list[Item]:
    """Constructs of a file in source order; none for unknown or unreadable source. Measures and shapes only if asked for."""
    lang = language(path)
    if lang is None:
        return []
    return _python(text, measured) if lang == "Python" else _ruby(text) if lang == "Ruby" else _braces(text, lang, measured)


def functions(path: str, text: str) -> list[dict]:
    """Measures of each function of the measured languages."""
    lang = language(path)
    if lang not in METRIC:
        return []
    kinds = classify(text, lang)
    out = []
    for f in items(path, text):
        if f.kind not in ("function", "method", "closure"):
            continue
        sloc = sum(k == "code" for k in kinds[f.start - 1 : f.end])
        raw = 171 - 5.2 * math.log(max(f.volume, 1.0)) - 0.23 * f.cyclomatic - 16.2 * math.log(max(sloc, 1))
        out.append({
            "path": path, "function": f.name or "<anonymous>", "line": f.start, "size": f.end - f.start + 1, "cyclomatic": f.cyclomatic, "cognitive": f.cognitive, "mi": int(math.floor(min(100.0, max(0.0, raw * 100 / 171)) + 0.5)),
            "lines": sloc, "args": f.params, "exits": f.exits, "language": lang, "shape": md5(f.skeleton.encode()).hexdigest(),
        })
    return out


def documented(path: str, text: str) -> tuple[int, int]:
    """(public items, documented ones) of a file."""
    found = [f for f in items(path, text, measured=False) if f.kind not in ("closure", "impl") and f.public and f.name]
    return len(found), sum(f.documented for f in found)
