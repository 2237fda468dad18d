"""Line items from a page's rows: below a header row, or by their shape where there is none.

A header names at least two of description, quantity and amount. Of a row below it, what is text is the description;
numbers are measurements: a percentage is the tax rate, the rest quantity, price, amount and gross amount by their number.
A row without measurements goes on with the description of the row before.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame

HEADER = {
    "description": ("description", "item", "product", "details", "service"),
    "quantity": ("qty", "quantity", "hours", "units"),
    "amount": ("amount", "total", "line total", "price", "unit price", "rate"),
}
ENDS = ("subtotal", "sub total", "total", "tax", "amount due", "balance due")
NUMBER = re.compile(r"[$€£]?-?\d[\d,]*(?:[.]\d+)?")
PERCENT = re.compile(r"\d+(?:[.]\d+)?%")
LINES = "doc_id long, page_no int, line_no int, description string, quantity string, unit_price string, amount string, gross_amount string, tax_rate string"


def _value(text: str) -> float:
    return float(re.sub(r"[^\d.-]", "", text.replace(",", "")) or "nan")


def measurements(numbers: list[str], rates: list[str]) -> dict[str, str | None]:
    """Quantity, price, amount, gross amount and rate of a row's numbers from left to right."""
    out: dict[str, str | None] = {"quantity": None, "unit_price": None, "amount": None, "gross_amount": None, "tax_rate": rates[-1] if rates else None}
    money = list(numbers)
    if len(money) >= 2 and re.fullmatch(r"\d+([.]\d+)?", money[0]) and _value(money[0]) < 10_000:
        out["quantity"] = money.pop(0)
    if rates and len(money) >= 3:
        out["unit_price"], out["amount"], out["gross_amount"] = money[-3:]
    elif rates and len(money) == 2:
        q = _value(out["quantity"]) if out["quantity"] else None
        first, second = map(_value, money)
        if q and q > 1 and abs(first * q - second) <= max(0.05, second * 0.03):
            out["unit_price"], out["amount"] = money
        else:
            out["amount"], out["gross_amount"] = money
            out["unit_price"] = f"{first / q:.2f}" if q else None
    elif len(money) >= 2:
        out["unit_price"], out["amount"] = money[0], money[-1]
    elif money:
        out["amount"] = money[0]
    return out


def lines_of_page(page: pd.DataFrame) -> pd.DataFrame:
    """The line items of one page of rows."""
    items: list[dict] = []
    rows = [list(r.sort_values("place")["text"]) for _, r in page.groupby("row_no", sort=True)]
    texts = [" ".join(r).lower() for r in rows]
    named = [{k for k, ws in HEADER.items() if any(w in t for w in ws)} for t in texts]
    header = next((k for k, n in enumerate(named) if len(n) >= 2 and not any(NUMBER.fullmatch(x) for x in rows[k])), None)
    for k in range(0 if header is None else header + 1, len(rows)):
        tokens = rows[k]
        if any(texts[k].startswith(w) for w in ENDS):
            if items:
                break
            continue
        tail = len(tokens)
        while tail and (NUMBER.fullmatch(tokens[tail - 1]) or PERCENT.fullmatch(tokens[tail - 1])):
            tail -= 1
        numbers = [x for x in tokens[tail:] if NUMBER.fullmatch(x)]
        rates = [x for x in tokens[tail:] if PERCENT.fullmatch(x)]
        words = " ".join(tokens[:tail])
        if len(numbers) >= (1 if header is not None else 2) and words and ":" not in words:
            items.append({"description": words, **measurements(numbers, rates)})
        elif header is not None and items and words and not numbers:
            items[-1]["description"] += f" {words}"
    names = [c.split()[0] for c in LINES.split(", ")]
    out = pd.DataFrame(items, columns=names[3:])
    out.insert(0, "line_no", range(1, len(items) + 1))
    out.insert(0, "page_no", page["page_no"].iloc[0])
    out.insert(0, "doc_id", page["doc_id"].iloc[0])
    return out.astype({"line_no": "int32", "page_no": "int32"})


def page_lines(rows: DataFrame) -> DataFrame:
    """The line items of all pages."""
    return rows.select("doc_id", "page_no", "row_no", "place", "text").groupBy("doc_id", "page_no").applyInPandas(lines_of_page, LINES)
