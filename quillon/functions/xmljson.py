"""XML fragments as JSON: attributes under @name, mixed text under "text", repeated elements as lists."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_PART = re.compile(r'<!\[CDATA\[(?P<cdata>.*?)\]\]>|<(?P<end>/)?(?P<name>[^\s/>"=]+)(?P<attributes>(?:\s+[^\s=>]+\s*=\s*"[^"]*")*)\s*(?P<empty>/)?>|(?P<text>[^<]+|<)', re.S)
_ATTRIBUTE = re.compile(r'([^\s=]+)\s*=\s*"([^"]*)"')


def _plain(s: str) -> str:
    """Backslashes and quotes that are escaped already, as themselves."""
    return re.sub(r'\\([\\"])', r"\1", s)


def _value(attributes: dict, text: str, children: list[tuple[str, object]], lists: frozenset):
    out: dict = dict(attributes)
    for name, child in children:
        if name in lists:
            out.setdefault(name, []).extend([] if child == "" else [child])
        elif name in out:
            out[name] = [*(out[name] if isinstance(out[name], list) else [out[name]]), child]
        else:
            out[name] = child
    if not out:
        return text
    return {**out, "text": text} if text.strip() or ("" != text and not children) else out


def xml_to_json(xml: str | None, lists: tuple[str, ...] = ()) -> str | None:
    """The JSON of a fragment; elements named in ``lists`` are lists even if there is one or none."""
    if xml is None:
        return None
    names = frozenset(lists)
    stack: list[list] = [["", {}, [], [], False]]  # name, attributes, text parts, children, had CDATA
    for m in _PART.finditer(xml):
        top = stack[-1]
        if m["cdata"] is not None:
            top[2].append(m["cdata"])
            top[4] = True
        elif m["text"] is not None:
            top[2].append(m["text"])
        elif m["end"]:
            if len(stack) > 1:
                _close(stack, names)
        else:
            stack.append([m["name"], {f"@{k}": _plain(v) for k, v in _ATTRIBUTE.findall(m["attributes"])}, [], [], False])
            if m["empty"]:
                _close(stack, names)
    while len(stack) > 1:
        _close(stack, names)
    _, _, text, children, _ = stack[0]
    whole = _value({}, _plain("".join(text)) if not children else _plain("".join(text)).strip(), children, names)
    return json.dumps(whole, ensure_ascii=False, separators=(",", ":"))


def _close(stack: list, lists: frozenset) -> None:
    name, attributes, text, children, cdata = stack.pop()
    value = _value(attributes, _plain("".join(text)), children, lists)
    if cdata and isinstance(value, dict) and "text" not in value and not children:
        value["text"] = ""
    stack[-1][3].append((name, value))


def xml_to_json_col(xml: Column, lists: tuple[str, ...] = ()) -> Column:
    @F.pandas_udf(StringType())
    def convert(values: pd.Series) -> pd.Series:
        return values.map(lambda x: xml_to_json(x, lists))

    return convert(xml)
