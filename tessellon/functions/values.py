"""Single values as text, in Python, for the parsers: the same texts as the columns of render.py."""

from __future__ import annotations

import datetime
import math
from decimal import Decimal


def double(x: float) -> str:
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    if x == int(x) and abs(x) < 1e15:
        return str(int(x))
    if abs(x) < 1e-4 or abs(x) >= 1e15:
        sign, digits, power = Decimal(repr(x)).as_tuple()
        lead = "".join(map(str, digits)).rstrip("0") or "0"
        power += len(digits) - 1
        return f"{'-' * sign}{lead[0]}{'.' + lead[1:] if len(lead) > 1 else ''}E{'-' if power < 0 else '+'}{abs(power):02d}"
    return repr(x)


def date_time(seconds: float) -> str:
    return (datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=math.floor(seconds))).strftime("%m/%d/%Y %H:%M:%S")


def time_span(seconds: float) -> str:
    ticks = 0 if math.isnan(seconds) or math.isinf(seconds) else math.floor(abs(seconds) * 1e7 + 0.5)
    whole, part = divmod(ticks, 10_000_000)
    day, rest = divmod(whole, 86400)
    text = f"{day}." if day else ""
    return ("-" if seconds < 0 and ticks else "") + text + f"{rest // 3600:02d}:{rest // 60 % 60:02d}:{rest % 60:02d}" + (f".{part:07d}" if part else "")


#: Type names of the reports and how their values are written.
TEXT = {
    "String": str,
    "Boolean": lambda v: "True" if v else "False",
    "Int32": str,
    "Int64": str,
    "UInt64": str,
    "Double": double,
    "DateTime": date_time,
    "TimeSpan": time_span,
    "Binary": lambda v: v.hex().upper(),
    "Dimensions": lambda v: f"{v[0]}, {v[1]}",
    "CropSides": lambda v: ", ".join(map(str, v)),
    "StereoModes": str,
    "DisplayUnit": str,
    "AspectRatioBehavior": str,
}
_AMP = {"&": "&amp;", "<": "&lt;", ">": "&gt;"}


def xml_safe(text: str, quote: bool = False) -> str:
    """Escaped, without characters that XML can't hold."""
    kept = (c for c in text if c in "\t\n\r" or " " <= c <= "퟿" or "" <= c <= "�" or c > "￿")
    return "".join(_AMP.get(c, "&quot;" if quote and c == '"' else c) for c in kept)


def xml_name(name: str) -> str:
    out = "".join(c if c.isalnum() or c in "_-." else "_" for c in name)
    return out if out and (out[0].isalpha() or out[0] == "_") else "_" + out


def xml(element: tuple, depth: int = 0) -> str:
    """An element (name, attributes, text or list of elements), indented by two blanks."""
    name, attributes, inside = element
    pad = "  " * depth
    head = xml_name(name) + "".join(f' {xml_name(k)}="{xml_safe(v, True)}"' for k, v in attributes.items())
    if not inside:
        return f"{pad}<{head} />"
    if isinstance(inside, str):
        return f"{pad}<{head}>{xml_safe(inside)}</{xml_name(name)}>"
    return "\n".join([f"{pad}<{head}>", *(xml(e, depth + 1) for e in inside), f"{pad}</{xml_name(name)}>"])
