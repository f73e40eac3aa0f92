"""Tolerant Java declaration scanner (E2-E5, E12-E14 inputs), run per file inside ``mapInPandas``.

Only declarations are recognised — types (class / interface / enum / record, nested ones with
their ``outer`` path), methods and constructors with parameter types and names, return type,
throws, the body text and character offsets, and whether a ``/** … */`` block sits right before
the declaration.  Comments and string / char literals are masked first so braces inside them do
not count.  A file that cannot be scanned yields one row with ``error`` set (parse quarantine); a
member header that is not understood yields such a row with its ``start``, beside the file's other
members.  Enum constants are no members, the methods in a constant's body are members of the enum.
Everything after this per-file step is Spark expressions.
"""

from __future__ import annotations

import re

import pandas as pd

from legible.functions.text import LEXEME

UNIT_SCHEMA = ("file string, pkg string, unit_kind string, type_kind string, class_name string, outer string, "
               "method_name string, param_types array<string>, param_names array<string>, return_type string, "
               "throws array<string>, header string, code string, start int, end int, has_doc boolean, "
               "doc_start int, ordinal int, error string, n_members int, indent string, head string, "
               "n_statements int")

_TYPE_RE = re.compile(r"\b(class|interface|enum|record)\s+([A-Za-z_$][\w$]*)")
_ANNOT_RE = re.compile(r"@(?!interface\b)[\w$.]+\s*")
_LEX_RE = re.compile(LEXEME)
_STRUCT_RE = re.compile(r"[(){};]")
_BODY_RE = re.compile(r"[(){};]|\bdo\b")
_NEXT_RE = re.compile(r"\s*(\w+|\S|$)")
_MODS = r"(?:(?:public|protected|private|static|final|abstract|synchronized|native|default|strictfp)\s+)*"
_METHOD_RE = re.compile(r"^" + _MODS + r"([\w$.<>\[\]?, ]+?)\s+([A-Za-z_$][\w$]*)\s*"
                        r"\(([^()]*)\)\s*(?:\[\s*\])*\s*(?:throws\s+([\w$.,\s]+?))?\s*(?:default\s+[^;{]*)?$", re.S)
_CTOR_RE = re.compile(r"^" + _MODS + r"([A-Za-z_$][\w$]*)\s*\(([^()]*)\)\s*"
                      r"(?:throws\s+([\w$.,\s]+?))?\s*$", re.S)
_KEYWORDS = {"if", "for", "while", "switch", "catch", "synchronized", "return", "new", "else", "try", "do"}


def mask(text: str) -> str:
    """Blank out comments and string/char/text-block literals, keeping offsets and newlines."""
    return _LEX_RE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def without_annotations(header: str) -> str:
    """A header without its annotations; their arguments are skipped by counting brackets."""
    out, at = [], 0
    for m in _ANNOT_RE.finditer(header):
        if m.start() < at:
            continue
        out.append(header[at:m.start()])
        at = m.end()
        if header[at:at + 1] == "(":
            depth = 0
            for k in range(at, len(header)):
                depth += (header[k] == "(") - (header[k] == ")")
                if depth == 0:
                    at = k + 1
                    break
        out.append(" ")
    return "".join(out) + header[at:]


def without_type_parameters(header: str) -> str:
    """A member header without its leading ``<T extends X<T>>``."""
    at = re.match(_MODS, header).end()
    if header[at:at + 1] != "<":
        return header
    depth = 0
    for k in range(at, len(header)):
        depth += (header[k] == "<") - (header[k] == ">")
        if depth == 0:
            return header[:at] + header[k + 1:].lstrip()
    return header


def count_statements(body: str) -> int:
    """Top-level statements of a masked ``{ ... }`` body: what ends one, unless the same statement goes on
    (else, catch, finally, the while of a do) or the brace closes part of an expression."""
    n = depth = paren = dos = 0
    for m in _BODY_RE.finditer(body):
        c = m[0]
        if c in "()":
            paren = max(0, paren + (1 if c == "(" else -1))
        elif paren:
            continue
        elif c == "do":
            dos += depth == 1
        elif c == "{":
            depth += 1
        else:
            depth -= c == "}"
            if depth == 1:
                word = _NEXT_RE.match(body, m.end())[1]
                if dos and word == "while":
                    dos -= 1
                elif word not in ("else", "catch", "finally") and not (c == "}" and word and word in ";,.)]:?"):
                    n += 1
    return n


def split_params(s: str) -> list[tuple[str, str]]:
    """``Map<K, V> m, final int... xs`` -> [(type, name), …] (top-level commas only)."""
    parts, depth, cur = [], 0, []
    for ch in s:
        if ch == "<":
            depth += 1
        elif ch == ">":
            depth -= 1
        if ch == "," and depth == 0:
            parts.append("".join(cur))
            cur = []
        else:
            cur.append(ch)
    if "".join(cur).strip():
        parts.append("".join(cur))
    out = []
    for p in parts:
        p = without_annotations(p).replace("final ", " ").strip()
        if not p:
            continue
        m = re.match(r"^(.*?)\s*([A-Za-z_$][\w$]*)\s*((?:\[\s*\])*)$", p, re.S)
        if not m or not m.group(1).strip():
            out.append((re.sub(r"\s+", "", p), ""))
            continue
        typ = re.sub(r"\s+", "", m.group(1)) + re.sub(r"\s+", "", m.group(3))
        out.append((typ.replace(",", ", "), m.group(2)))
    return out


def _doc_before(text: str, masked: str, pos: int):
    """Start offset of a ``/** */`` block that ends right before ``pos`` (annotations allowed between)."""
    j = pos
    while True:
        k = j
        while k > 0 and text[k - 1].isspace():
            k -= 1
        if text.endswith("*/", 0, k):
            start = text.rfind("/*", 0, k - 2)
            if start >= 0 and text.startswith("/**", start) and not text.startswith("/**/", start):
                return start
            return None
        return None


def scan_java(file: str, text: str) -> list[dict]:
    text = text or ""
    masked = mask(text)
    pm = re.search(r"^\s*package\s+([\w$.]+)\s*;", masked, re.M)
    pkg = pm.group(1) if pm else ""
    rows, stack = [], []           # frames: dict(kind, …)
    boundary, ordinal = 0, 0

    def header_span(a, b):
        seg = masked[a:b]
        lead = len(seg) - len(seg.lstrip())
        return a + lead, masked[a + lead:b]

    def indent_of(pos):
        ls = text.rfind("\n", 0, pos) + 1
        lead = text[ls:pos]
        return lead if lead.strip() == "" else ""

    def outer_path():
        return ".".join(f["name"] for f in stack if f["kind"] == "type")

    def error(message, start=None, end=None):
        return dict(file=file, pkg=pkg, unit_kind="error", type_kind=None, class_name=None, outer=None, method_name=None,
                    param_types=[], param_names=[], return_type=None, throws=[], header=None, code=None, start=start, end=end,
                    has_doc=None, doc_start=None, ordinal=None, error=message, n_members=None, indent=None, head=None,
                    n_statements=None)

    def in_type():
        return bool(stack) and stack[-1]["kind"] in ("type", "constant")

    def member(hs, header, body_start, body_end):
        nonlocal ordinal
        h = re.sub(r"\s+", " ", without_annotations(header)).strip()
        owner = next(f for f in reversed(stack) if f["kind"] == "type")
        bare = without_type_parameters(h)
        cm = _CTOR_RE.match(bare)
        mm = _METHOD_RE.match(bare)
        if cm and cm.group(1) == owner["name"]:
            kind, name, params, thr, ret = "ctor", cm.group(1), cm.group(2), cm.group(3), None
        elif mm and mm.group(2) not in _KEYWORDS and mm.group(1).split()[-1] not in ("new", "return", "else"):
            kind, name, params, thr, ret = "method", mm.group(2), mm.group(3), mm.group(4), mm.group(1).strip()
        else:
            if "(" in h and "=" not in h.split("(")[0]:
                rows.append(error("member header not understood at %d: %s" % (hs, h[:80]), hs, body_start))
            return False
        ps = split_params(params)
        doc = _doc_before(text, masked, hs)
        end = body_end if body_end is not None else body_start
        ordinal += 1
        rows.append(dict(file=file, pkg=pkg, unit_kind=kind, type_kind=owner["type_kind"], class_name=owner["name"],
                         outer=".".join([f["name"] for f in stack if f["kind"] == "type"][:-1]),
                         method_name=name, param_types=[t for t, _ in ps], param_names=[n for _, n in ps],
                         return_type=ret, throws=[t.strip() for t in (thr or "").split(",") if t.strip()],
                         header=h, code=text[body_start:end] if body_end is not None else "",
                         start=hs, end=end, has_doc=doc is not None, doc_start=doc, ordinal=ordinal, error=None,
                         n_members=0, indent=indent_of(hs), head=text[hs:body_start], n_statements=0))
        owner["members"] += 1
        return True

    def constants():
        """Whether the innermost open brace is an enum whose constant list has not ended."""
        return bool(stack) and stack[-1].get("constants", False)

    try:
        paren = 0
        for at in _STRUCT_RE.finditer(masked):
            c, i = at[0], at.start()
            # braces and semicolons inside parentheses (annotation arrays, lambdas passed as
            # arguments, for-loop headers) are not declaration structure
            if c == "(":
                paren += 1
            elif c == ")":
                paren = max(0, paren - 1)
            elif paren > 0:
                pass
            elif c == "{":
                hs, header = header_span(boundary, i)
                tm = None
                if constants():
                    stack.append(dict(kind="constant"))
                    boundary = i + 1
                    continue
                if not stack or in_type():
                    found = list(_TYPE_RE.finditer(header))
                    tm = found[-1] if found and "(" not in without_annotations(header[:found[-1].start()]) else None
                if tm is not None:
                    ordinal += 1
                    doc = _doc_before(text, masked, hs)
                    stack.append(dict(kind="type", name=tm.group(2), type_kind=tm.group(1), start=hs, body=i,
                                      members=0, ordinal=ordinal, doc=doc, constants=tm.group(1) == "enum",
                                      header=re.sub(r"\s+", " ", without_annotations(header)).strip()))
                elif in_type() and header and member(hs, header, i, None):
                    stack.append(dict(kind="member", row=len(rows) - 1, body=i))
                else:
                    stack.append(dict(kind="block"))
                boundary = i + 1
            elif c == "}":
                if not stack:
                    raise ValueError("unbalanced '}' at %d" % i)
                f = stack.pop()
                if f["kind"] == "member":
                    r = rows[f["row"]]
                    r["end"] = i + 1
                    r["code"] = text[f["body"]:i + 1]
                    r["n_statements"] = count_statements(masked[f["body"]:i + 1])
                elif f["kind"] == "type":
                    rows.append(dict(file=file, pkg=pkg, unit_kind="type", type_kind=f["type_kind"], class_name=f["name"],
                                     outer=outer_path(), method_name="", param_types=[], param_names=[],
                                     return_type=None, throws=[], header=f["header"], code=text[f["start"]:i + 1],
                                     start=f["start"], end=i + 1, has_doc=f["doc"] is not None, doc_start=f["doc"],
                                     ordinal=f["ordinal"], error=None, n_members=f["members"],
                                     indent=indent_of(f["start"]), head="", n_statements=None))
                boundary = i + 1
            elif c == ";":
                if constants():
                    stack[-1]["constants"] = False
                elif in_type():
                    hs, header = header_span(boundary, i)
                    if "(" in header and "=" not in header.split("(")[0]:
                        member(hs, header, i + 1, None)
                boundary = i + 1
        if stack:
            raise ValueError("unbalanced '{' (%d open)" % len(stack))
    except ValueError as e:
        return [error(str(e))]
    return rows


#: Declarations and characters of text that one output frame holds (the file that passes them is its last).
FRAME_ROWS, FRAME_CHARS = 1000, 1 << 22


def scan_partitions(batches, file_col: str = "rel_path", text_col: str = "text"):
    """``mapInPandas`` body: one output row per declaration of every file in the batch, in frames of bounded size."""
    cols = [c.split(" ")[0] for c in UNIT_SCHEMA.split(", ")]

    def frame(out):
        df = pd.DataFrame(out, columns=cols)
        for c in ("start", "end", "doc_start", "ordinal", "n_members", "n_statements"):
            df[c] = pd.array(df[c], dtype="Int32")
        return df

    for pdf in batches:
        out, chars = [], 0
        for f, t in zip(pdf[file_col], pdf[text_col]):
            out.extend(scan_java(f, t))
            chars += len(t or "")
            if len(out) >= FRAME_ROWS or chars >= FRAME_CHARS:
                yield frame(out)
                out, chars = [], 0
        yield frame(out)
