"""Rows as sorted text, so that two engines' results can be held against each other."""

DATA = "/root/testdata/sf0.001"


def plain(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.6g}" if abs(float(v)) > 1e-9 else "0"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


def lines(rows, columns, names) -> list[str]:
    at = [columns.index(n) for n in names]
    return sorted("|".join(plain(r[i]) for i in at) for r in rows)
