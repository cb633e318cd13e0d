"""Python-`re` compatible building blocks for Java regexes.

Python's ``re`` on ``str`` is Unicode aware; Java's defaults are not the same.
The macros below reproduce Python's ``\\s``, ``\\w``, ``\\d`` and ``\\b`` so the
same pattern text gives the same matches in ``rlike`` / ``regexp_extract_all``.
"""

from __future__ import annotations

# Python \s  (str.isspace): ASCII controls 0x09-0x0D, 0x1C-0x1F, space, NEL, Unicode Z*
WS = r"[\t-\r\x1c-\x20\x85\p{Z}]"
NOT_WS = r"[^\t-\r\x1c-\x20\x85\p{Z}]"
# Python \w: letters, numbers, underscore
W = r"[\p{L}\p{N}_]"
NOT_W = r"[^\p{L}\p{N}_]"
# Python \d: decimal digits
D = r"\p{Nd}"
# Python \b: word/non-word transition
B = r"(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))"
# \b right before / right after a character that is itself a word character
B_BEFORE_WORD = r"(?<![\p{L}\p{N}_])"
B_AFTER_WORD = r"(?![\p{L}\p{N}_])"
# str.isprintable() is False exactly for categories C* and Z* other than ' '
NON_PRINTABLE = r"[\p{C}\p{Z}&&[^ ]]"

_CLASS_MACROS = {"s": WS, "S": NOT_WS, "w": W, "W": NOT_W, "d": D}
_INNER_CLASS = {"s": r"\t-\r\x1c-\x20\x85\p{Z}", "w": r"\p{L}\p{N}_", "d": r"\p{Nd}"}


def literal_prefix(pattern: str) -> str | None:
    """The word a pattern must start with (``\\bword...``), for a cheap ``contains`` pre-check.

    None where the pattern has alternatives outside a group: then no word is needed."""
    if not pattern.startswith("\\b") or len(_group_alternatives(pattern)) > 1:
        return None
    j = 2
    while j < len(pattern) and (pattern[j].isalnum() or pattern[j] == "_"):
        j += 1
    nxt = pattern[j : j + 1]
    lit = pattern[2:j]
    if nxt in ("?", "*", "{") and lit:
        lit = lit[:-1]                      # last char is optional
    return lit or None


def _group_alternatives(body: str) -> list[str]:
    """Top-level alternatives of a group body (no nested-group parsing beyond depth)."""
    alts, depth, cur, i = [], 0, "", 0
    while i < len(body):
        ch = body[i]
        if ch == "\\":
            cur += body[i:i + 2]
            i += 2
            continue
        if ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        if ch == "|" and depth == 0:
            alts.append(cur)
            cur = ""
        else:
            cur += ch
        i += 1
    alts.append(cur)
    return alts


def _starts_with_word(alt: str) -> bool:
    return bool(alt) and (alt[0].isalnum() or alt[0] == "_")


def _ends_with_word(alt: str) -> bool:
    """True when every match of ``alt`` ends with a word character: a literal word
    char last, or an optional group ``(?:...)?`` whose body and prefix both do."""
    if alt.endswith(")?") and "(?:" in alt:
        head, opt = alt[: alt.rindex("(?:")], alt[alt.rindex("(?:") + 3: -2]
        return _ends_with_word(head) and all(_ends_with_word(a) for a in _group_alternatives(opt))
    return bool(alt) and (alt[-1].isalnum() or alt[-1] == "_") and not alt.endswith("\\" + alt[-1])


def _specialize_group_bounds(pattern: str) -> str:
    """``\\b(alt|alt)\\b`` where every alternative starts and ends with a word character:
    the boundaries become one-sided tests (same matches, far cheaper in Java)."""
    if not (pattern.startswith("\\b(") and pattern.endswith(")\\b")):
        return pattern
    body = pattern[3:-3]
    alts = _group_alternatives(body)
    if all(_starts_with_word(a) and _ends_with_word(a) for a in alts):
        return "\x00L(" + body + ")\x00R"
    return pattern


def to_java(pattern: str, ignore_case: bool = False) -> str:
    """Rewrite the escapes of a Python regex so Java matches like Python.

    Only the escapes whose meaning differs are touched (``\\s \\S \\w \\W \\d \\b``);
    everything else is passed through unchanged.
    """
    pattern = _specialize_group_bounds(pattern)
    out: list[str] = []
    i, in_class = 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if in_class and nxt in _INNER_CLASS:
                out.append(_INNER_CLASS[nxt])
            elif not in_class and nxt in _CLASS_MACROS:
                out.append(_CLASS_MACROS[nxt])
            elif not in_class and nxt == "b":
                after = pattern[i + 2 : i + 3]
                before = pattern[i - 1 : i] if i > 0 and pattern[i - 2 : i - 1] != "\\" else ""
                if after and (after.isalnum() or after == "_"):
                    out.append(B_BEFORE_WORD)       # next char is a word char
                elif before and (before.isalnum() or before == "_"):
                    out.append(B_AFTER_WORD)        # previous char is a word char
                else:
                    out.append(B)
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
            out.append(ch)
            # a leading ']' or '^]' is literal in Python
            if pattern[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
            if pattern[i + 1 : i + 2] == "]":
                out.append(r"\]")
                i += 1
        elif ch == "]" and in_class:
            in_class = False
            out.append(ch)
        elif ch == "[" and in_class:
            out.append(r"\[")  # Java would read a nested class
        elif ch == "$" and not in_class:
            out.append(r"(?=\n?\z)")  # Python '$': end, or before a final newline
        else:
            out.append(ch)
        i += 1
    body = "".join(out)
    body = body.replace("\x00L", B_BEFORE_WORD).replace("\x00R", B_AFTER_WORD)
    return ("(?iu)" if ignore_case else "") + body
