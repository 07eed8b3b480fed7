"""Languages: extensions, file names, comment tokens. One line a language: name|extensions|names|line tokens|block pairs|flags.

Flags: n block comments nest, c a code language, s has shebangs. The table has the common languages; ``use`` adds those
of a table file, a JSON5 object of ``name -> {file_patterns, line_comments, block_comments, nested_blocks, shebangs}``,
which is sent to all workers.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import cache
from pathlib import Path

from pyspark import SparkFiles, TaskContext
from pyspark.sql import SparkSession

_TABLE = r"""
Ada|adb ads ada||--||c
Apache Config|htaccess|.htaccess|#||
AsciiDoc|adoc asciidoc|||//// ////|
Assembly|asm s||;||c
Astro|astro||//|/* */,<!-- -->|c
AutoHotkey|ahk||;|/* */|c
Awk|awk||#||cs
Bash|sh bash zsh ksh|.bashrc .profile|#||cs
Batch|bat cmd||rem ::||c
BibTeX|bib||%||
C|c h||//|/* */|c
C#|cs csx||//|/* */|c
C++|cpp cc cxx hpp hh hxx||//|/* */|c
CMake|cmake|CMakeLists.txt|#|#[[ ]]|c
COBOL|cob cbl||*||c
CSS|css|||/* */|c
CSV|csv||||
Clojure|clj cljs cljc edn||;||c
CoffeeScript|coffee||#|### ###|c
Common Lisp|lisp lsp cl||;|#| |#|nc
Crystal|cr||#||cs
Cuda|cu cuh||//|/* */|c
D|d||//|/* */,/+ +/|nc
Dart|dart||//|/* */|nc
Dockerfile|dockerfile|Dockerfile|#||c
Dotenv|env|.env|#||
EditorConfig||.editorconfig|# ;||
Elixir|ex exs||#||cs
Elm|elm||--|{- -}|nc
Erlang|erl hrl||%||cs
F#|fs fsi fsx||//|(* *)|nc
Fortran|f90 f95 f03 f||!||c
GLSL|glsl vert frag||//|/* */|c
Go|go||//|/* */|c
GraphQL|graphql gql||#||c
Groovy|groovy gradle|Jenkinsfile|//|/* */|cs
HCL|tf hcl tfvars||# //|/* */|c
HTML|html htm xhtml|||<!-- -->|c
Haskell|hs lhs||--|{- -}|ncs
INI|ini cfg properties||; #||
JSON|json webmanifest||||
JSON5|json5||//|/* */|
Java|java||//|/* */|c
JavaScript|js jsx mjs cjs||//|/* */|cs
Julia|jl||#|#= =#|ncs
Kotlin|kt kts||//|/* */|nc
Less|less||//|/* */|c
Lua|lua||--|--[[ ]]|cs
Makefile|mk mak|Makefile makefile GNUmakefile|#||c
Markdown|md markdown mdx|||<!-- -->|
MATLAB|mlx||%|%{ %}|nc
Nim|nim||#|#[ ]#|nc
Nix|nix||#|/* */|c
OCaml|ml mli|||(* *)|nc
Objective-C|m mm||//|/* */|c
Org|org||#||
PHP|php phtml||// #|/* */|cs
Pascal|pas pp dpr||//|{ },(* *)|nc
Perl|pl pm||#|=pod =cut|cs
PowerShell|ps1 psm1 psd1||#|<# #>|c
Prolog|pro||%|/* */|c
Protocol Buffers|proto||//|/* */|c
Python|py pyi pyw||#|''' ''',~ ~|cs
R|r||#||cs
Racket|rkt||;|#| |#|nc
Raku|raku rakumod||#||c
Roff|roff man||||
Ruby|rb rake gemspec|Rakefile|#|=begin =end|cs
Rust|rs||//|/* */|nc
SCSS|scss sass||//|/* */|c
SQL|sql||--|/* */|c
SVG|svg|||<!-- -->|
Scala|scala sc||//|/* */|nc
Scheme|scm ss||;|#| |#|nc
Solidity|sol||//|/* */|c
Svelte|svelte||//|/* */,<!-- -->|c
Swift|swift||//|/* */|nc
TOML|toml||#||
Tcl|tcl||#||cs
TeX|tex sty||%||c
Textile|textile||||
TypeScript|ts tsx mts cts||//|/* */|cs
V|v||//|/* */|c
VHDL|vhd vhdl||--|/* */|c
Verilog|sv svh||//|/* */|c
Vim Script|vim|.vimrc|"||c
Visual Basic|vb vbs||'||c
Vue|vue||//|/* */,<!-- -->|c
XML|xml xsd xsl xslt plist|||<!-- -->|
YAML|yaml yml||#||
Zig|zig||//||c
reStructuredText|rst||..||
"""


@dataclass(frozen=True)
class Language:
    name: str
    extensions: tuple[str, ...]
    names: tuple[str, ...]
    line: tuple[str, ...]
    block: tuple[tuple[str, str], ...]
    nested: bool
    code: bool
    shebang: bool


_PROPERTY = "commitscope.languages"
_chosen: str | None = None


def use(spark: SparkSession, path: str | None) -> None:
    """Adds the languages of a table file, here and in the tasks of this session; None takes them away again."""
    global _chosen
    _chosen = path
    if path:
        spark.sparkContext.addFile(path)
    spark.sparkContext.setLocalProperty(_PROPERTY, Path(path).name if path else None)


def _table() -> str | None:
    """The table file in use, as this process sees it."""
    context = TaskContext.get()
    if context is None:
        return _chosen
    name = context.getLocalProperty(_PROPERTY)
    return SparkFiles.get(name) if name else None


_JSON5 = re.compile(r"""//[^\n]*|/\*.*?\*/|("(?:\\.|[^"\\])*")|'((?:\\.|[^'\\])*)'|([A-Za-z_$][\w$]*)(?=\s*:)|,(?=(?:\s|//[^\n]*|/\*.*?\*/)*[}\]])""", re.S)


def read_table(path: str) -> dict[str, dict]:
    """A JSON5 file: comments, keys without quotes, single quotes and commas at the end are understood."""

    def plain(m: re.Match) -> str:
        if m[1] is not None:
            return m[1]
        if m[2] is not None:
            return json.dumps(m[2].replace("\\'", "'"))
        return json.dumps(m[3]) if m[3] else ""

    return json.loads(_JSON5.sub(plain, Path(path).read_text(encoding="utf-8")))


# Languages that are data, markup or configuration.
NO_CODE = {
    "Apache Config", "AsciiDoc", "BibTeX", "CSV", "Dotenv", "EditorConfig", "INI", "JSON", "JSON5", "Markdown", "Nginx Config", "Org", "reStructuredText", "Roff", "SVG", "Textile", "TOML", "WiX", "XML", "YAML",
}


def languages() -> dict[str, Language]:
    return _languages(_table())


@cache
def _languages(table: str | None) -> dict[str, Language]:
    out = _built_in()
    for name, x in (read_table(table) if table else {}).items():
        patterns = x.get("file_patterns", [])
        ends = tuple(p[2:].lower() for p in patterns if p.startswith("*."))
        names = tuple(p for p in patterns if "*" not in p)
        block = tuple((a, b) for a, b in x.get("block_comments", []))
        out[name] = Language(name, ends, names, tuple(x.get("line_comments", [])), block, bool(x.get("nested_blocks")), name not in NO_CODE, bool(x.get("shebangs")))
    return out


def _built_in() -> dict[str, Language]:
    out = {}
    for row in _TABLE.strip().splitlines():
        row = row.replace("#| |#", "\x00 \x01")
        name, ext, names, line, block, flags = row.split("|")
        pairs = [p.replace("~", '"""').replace("\x00", "#|").replace("\x01", "|#").split() for p in block.split(",") if p]
        out[name] = Language(name, tuple(ext.split()), tuple(names.split()), tuple(line.split()), tuple((a, b) for a, b in pairs), "n" in flags, "c" in flags, "s" in flags)
    return out


def by_extension() -> dict[str, str]:
    return _by_extension(_table())


@cache
def _by_extension(table: str | None) -> dict[str, str]:
    """The built-in language of an extension holds against those of a table file."""
    out = {e: x.name for x in _languages(table).values() for e in x.extensions}
    return out | {e: x.name for x in _built_in().values() for e in x.extensions}


def by_name() -> dict[str, str]:
    return _by_name(_table())


@cache
def _by_name(table: str | None) -> dict[str, str]:
    out = {n: x.name for x in _languages(table).values() for n in x.names}
    return out | {n: x.name for x in _built_in().values() for n in x.names}


#: Interpreters of scripts; version numbers behind them do not matter.
_SHEBANG = {
    "python": "Python", "pypy": "Python", "bash": "Bash", "sh": "Bash", "dash": "Bash", "ksh": "Bash", "zsh": "Bash", "node": "JavaScript", "nodejs": "JavaScript", "deno": "TypeScript", "ruby": "Ruby", "perl": "Perl", "raku": "Raku",
    "php": "PHP", "lua": "Lua", "Rscript": "R", "awk": "Awk", "gawk": "Awk", "tclsh": "Tcl", "groovy": "Groovy", "elixir": "Elixir", "escript": "Erlang", "julia": "Julia", "crystal": "Crystal", "pwsh": "PowerShell", "swift": "Swift", "runhaskell": "Haskell",
}
_OBJC = r"^\s*(@(interface|class|protocol|property|end|synchronised|selector|implementation)\b|#import\s+.+\.h[\">])"
#: Extensions of several languages: what tells one, in order. An empty pattern is the rest; without one the file stays unknown.
AMBIGUOUS: dict[str, tuple[tuple[str, str], ...]] = {
    "h": (("Objective-C", _OBJC), ("C++", r"^\s*#\s*include <(c?std\w+|string|vector|map|list|array|bitset|queue|stack|(unordered_)?(map|set)|[io]?o?stream|memory|functional|utility|algorithm)>|^\s*template\s*<|^[ \t]*(try|constexpr)\b|^[ \t]*catch\s*\(|^[ \t]*(class|(using[ \t]+)?namespace)\s+\w+|^[ \t]*(private|public|protected):$|std::\w+"), ("C", "")),
    "m": (("Objective-C", _OBJC), ("MATLAB", r"^\s*%|^\s*function\b|^\s*(end|classdef)\s*;?\s*$")),
    "mm": (("Objective-C", ""),),
    "pl": (("Prolog", r"^[^#\n]*:-"), ("Perl", r"\buse\s+(?:strict\b|v?5\b|warnings\b)|^\s*use\s+(?:constant|overload)\b|^\s*package\s+\w+(?:::\w+)*\s*[;{]|[\s$]\w+(?:::\w+)*->[a-zA-Z_\[({]|^\s*(?:my|our|sub)\b"), ("Raku", r"^\s*(?:use\s+v6\b|\bmodule\b|\b(?:my\s+)?class\b)")),
    "pm": (("Perl", r"\buse\s+(?:strict\b|v?5\b|warnings\b)|^\s*package\s+\w+(?:::\w+)*\s*[;{]"), ("Raku", r"^\s*(?:use\s+v6\b|\bmodule\b|\b(?:my\s+)?class\b)"), ("Perl", "")),
    "pro": (("Prolog", r"^[^\[#\n]+:-"), ("INI", r"^[\w-]+\s*=")),
    "ts": (("XML", r"<TS\b"), ("TypeScript", "")),
    "tsx": (("XML", r"\A\s*<\?xml\s+version"), ("TypeScript", "")),
    "rs": (("XML", r"\A\s*<\?xml"), ("Rust", "")),
    "cs": (("C#", ""),),
    "fs": (("GLSL", r"^\s*(#version|precision|uniform|varying|vec[234])"), ("F#", "")),
    "d": (("Makefile", r"([/\\].*:\s+.*\s\\$|: \\$|^[ %]:)"), ("D", "")),
    "v": (("V", r"^\s*(fn|module|pub|import)\s"), ("Verilog", r"^\s*(module\s+\w+|endmodule|always\b|assign\b|`\w+)")),
    "cls": (("TeX", r"^\s*\\(NeedsTeXFormat|ProvidesClass)\{"), ("Visual Basic", r"^\s*VERSION\b|^\s*Attribute VB_Name")),
    "r": (("R", ""),),
}


@cache
def _rules(extension: str) -> tuple[tuple[str, re.Pattern | None], ...]:
    return tuple((name, re.compile(pattern, re.M) if pattern else None) for name, pattern in AMBIGUOUS[extension])


def _by_shebang(content: str) -> str | None:
    if not content.startswith("#!"):
        return None
    words = content.split("\n", 1)[0][2:].split()
    if words and words[0].endswith("/env"):
        words = [w for w in words[1:] if not w.startswith("-") and "=" not in w]
    tool = words[0].rsplit("/", 1)[-1] if words else ""
    return _SHEBANG.get(tool) or _SHEBANG.get(tool.rstrip("0123456789.-"))


def detect(path: str, content: str | None = None) -> str | None:
    """Language of a file: by name, by extension, and without either by the first line's interpreter.

    Where an extension has several languages, the interpreter decides if it is of one of them, then patterns in the
    text; without the text it is the last of them.
    """
    name = path.rsplit("/", 1)[-1]
    if (got := by_name().get(name)) is not None:
        return got
    extension = name.rsplit(".", 1)[1].lower() if "." in name else ""
    if extension in AMBIGUOUS:
        rules = _rules(extension)
        if content is None:
            return by_extension().get(extension, rules[-1][0])
        tool = _by_shebang(content)
        if tool in (n for n, _ in rules):
            return tool
        return next((n for n, pattern in rules if pattern is None or pattern.search(content)), None)
    if (got := by_extension().get(extension)) is not None:
        return got
    return _by_shebang(content) if content else None
