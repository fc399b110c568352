"""Flow cytometry standard: the TEXT segment and its events."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Text(NamedTuple):
    values: dict[str, str]
    columns: list[str]
    begin: int
    end: int


def parse_text(head: bytes, read) -> Text:
    """Keywords, column names and the data range; ``read(start, end)`` gives bytes of the file."""
    if head[:3] != b"FCS":
        raise ValueError("not an FCS file")
    begin, end, d0, d1 = (int(head[k : k + 8].strip() or 0) for k in (10, 18, 26, 34))
    text = read(begin, end + 1).decode("utf-8", "replace")
    mark = text[0]
    # A doubled delimiter stands for itself inside a value.
    parts = text[1:].replace(mark * 2, "\0").rstrip("\r\n ").removesuffix(mark).split(mark)
    parts = [p.replace("\0", mark) for p in parts]
    values = {k.strip().upper(): v for k, v in zip(parts[::2], parts[1::2], strict=False)}
    n = int(values["$PAR"])
    names: list[str] = []
    for k in range(1, n + 1):
        name = (values.get(f"$P{k}S") or values.get(f"$P{k}N") or f"P{k}").strip()
        names.append(name if name not in names else f"{name}_{k}")
    return Text(values, names, d0 or int(values["$BEGINDATA"]), d1 or int(values["$ENDDATA"]))


def events(text: Text, data: bytes) -> np.ndarray:
    """Events by parameters, as 32-bit floats."""
    order = "<" if text.values.get("$BYTEORD", "1,2,3,4").strip().startswith("1") else ">"
    kind, n = text.values.get("$DATATYPE", "F").strip().upper(), len(text.columns)
    if kind in "FD":
        flat = np.frombuffer(data, order + ("f4" if kind == "F" else "f8"))
        return flat[: len(flat) // n * n].reshape(-1, n).astype(np.float32)
    if kind == "I":
        row = np.dtype([(f"c{k}", f"{order}u{int(text.values[f'$P{k + 1}B']) // 8}") for k in range(n)])
        x = np.frombuffer(data[: len(data) // row.itemsize * row.itemsize], row)
        return np.stack([x[c].astype(np.float32) for c in row.names], 1)
    raise ValueError(f"data type {kind!r}")
