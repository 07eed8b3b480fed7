"""Line classifier: code, comment, blank and shebang lines of a file, with block comments carried over lines."""

from __future__ import annotations

import re
from functools import cache

from commitscope.functions.languages import Language, languages


@cache
def _matchers(lang: Language) -> tuple[re.Pattern | None, dict[str, str], re.Pattern | None]:
    starts = re.compile("|".join(re.escape(a) for a, _ in lang.block)) if lang.block else None
    line = re.compile("|".join(re.escape(t) + (r"(?!\w)" if t[-1].isalnum() else "") for t in lang.line)) if lang.line else None
    return starts, dict(lang.block), line


def _any_end(lang: Language) -> re.Pattern:
    return re.compile("|".join([*(re.escape(b) for _, b in lang.block), *(re.escape(a) for a, _ in lang.block if lang.nested)]))


def classify(content: str, language: str | None) -> list[str]:
    """'code', 'comment', 'blank' or 'shebang' for each line; without a language every non-blank line is code.

    Block comments are looked for before line comments, so a block start after a line token still opens a block.
    """
    lang = languages().get(language) if language else None
    out: list[str] = []
    depth, lines = 0, content.split("\n")
    if lines and not lines[-1]:
        lines.pop()
    for k, raw in enumerate(lines):
        text = raw.strip(" \t\r\n\f")
        if not text:
            out.append("blank")
            continue
        if lang is None:
            out.append("code")
            continue
        if k == 0 and lang.shebang and text.startswith("#!"):
            out.append("shebang")
            continue
        starts, _, token = _matchers(lang)
        code = False
        while text and starts is not None:
            if not depth:
                if not (m := starts.search(text)):
                    break
                code |= bool(text[: m.start()].strip())
                text, depth = text[m.end() :], 1
            else:
                if not (m := _any_end(lang).search(text)):
                    break
                opened = lang.nested and m[0] in dict(lang.block) and m[0] not in dict(lang.block).values()
                depth = depth + 1 if opened else depth - 1 if lang.nested else 0
                text = text[m.end() :]
        if depth:
            out.append("code" if code else "comment")
            continue
        m = token.search(text) if token else None
        code |= bool((text[: m.start()] if m else text).strip())
        out.append("code" if code else "comment")
    return out


def count(content: str, language: str | None) -> dict[str, int]:
    kinds = classify(content, language)
    return {k: kinds.count(k) for k in ("code", "comment", "blank", "shebang")}
