"""Positioned tokens to rows, columns and transactions.

tokens: doc_id, page, tok (reading index), text, x0, y0, x1, y1. The unit of work
is a page: small joins are on (doc_id, page), greedy steps that depend on their own
earlier choices are folds over a page, and steps over documents go in blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import MONEY, clean_amount, indicator, let
from ..functions.text import TYPED_CREDIT, TYPED_DEBIT
from .blocks import transducer


def assign_columns(tokens: DataFrame, columns: DataFrame, default: str | None = "DESCRIPTION") -> DataFrame:
    """Name of the first column (doc_id, page, ord, name, x0, x1) whose closed range has the token's centre; without a default unmatched tokens go."""
    ranges = columns.where("doc_id is not null and page is not null").select("doc_id", "page", F.struct("ord", "name", F.col("x0").alias("lo"), F.col("x1").alias("hi")).alias("__range"))
    # Ranges travel as rows of their page: one sort of slim rows, where a join would sort the tokens and an array a page beside them.
    both = tokens.withColumn("__token", F.lit(True)).unionByName(ranges, allowMissingColumns=True)
    known = both.withColumn("__ranges", F.collect_list("__range").over(Window.partitionBy("doc_id", "page"))).where("__token")
    centre = (F.col("x0") + F.col("x1")) / 2
    named = known.withColumn("column", F.array_min(F.filter("__ranges", lambda c: centre.between(c["lo"], c["hi"])))["name"]).select(*tokens.columns, "column")
    return named.where("column is not null") if default is None else named.withColumn("column", F.coalesce("column", F.lit(default)))


def column_bounds(headers: DataFrame) -> DataFrame:
    """Ranges of header words (doc_id, page, name, x0, x1) stretched to the midpoints between neighbours, 0 and 10000 at the ends."""
    w = Window.partitionBy("doc_id", "page").orderBy("x0", "name")
    left, right = F.lag("x1").over(w), F.lead("x0").over(w)
    return headers.select("doc_id", "page", "name", (F.row_number().over(w) - 1).cast("long").alias("ord"), F.coalesce((left + F.col("x0")) / 2, F.lit(0.0)).alias("lo"), F.coalesce((F.col("x1") + right) / 2, F.lit(10_000.0)).alias("hi"))


def rows_text(tokens: DataFrame, row: str = "row") -> DataFrame:
    """Text of each row from left to right, its box and its number of tokens."""
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "tok", "text"))), lambda t: t["text"]), " ")
    return tokens.groupBy("doc_id", "page", row).agg(words.alias("row_text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("tokens"))


def regions(tokens: DataFrame, height: Column) -> DataFrame:
    """Zones of each token by its relative height; one token may lie in two."""
    rel, first = F.col("y0") / height, F.col("page") == 1
    zone = lambda test, name: F.when(test, name)
    table = F.when(first, (rel >= 0.38) & (rel < 0.88)).otherwise((rel >= 0.08) & (rel < 0.92))
    zones = F.array_compact(F.array(zone(first & (rel < 0.15), "HEADER"), zone(first & (rel >= 0.15) & (rel < 0.38), "ACCOUNT_INFORMATION"), zone(table, "TRANSACTION_TABLE"), zone(rel >= 0.88, "SUMMARY"), zone(rel >= 0.88, "FOOTER")))
    return tokens.select("*", F.explode(zones).alias("region"))


def table_zone(tokens: DataFrame, headers: DataFrame) -> DataFrame:
    """Tokens below the header band (doc_id, page, header_y1) of their page; pages without one give none."""
    return tokens.join(headers, ["doc_id", "page"]).where(F.col("y0") >= F.col("header_y1") - 2)


def schema_score(names: Column) -> Column:
    """How good a table header is: 10 a column, more for debit and credit, balance and date."""
    has = lambda n: F.array_contains(names, n)
    return F.size(names) * 10 + F.when(has("DEBIT") & has("CREDIT"), 25).otherwise(0) + F.when(has("BALANCE"), 15).otherwise(0) + F.when(has("DATE"), 10).otherwise(0)


def dominant_schema(pages: DataFrame) -> DataFrame:
    """Best header of each document (doc_id, page, names); among equals the first page's."""
    scored = pages.where(F.col("names").isNotNull()).withColumn("score", schema_score(F.col("names")))
    return scored.groupBy("doc_id").agg(F.max_by(F.struct("page", "names", "score"), F.struct("score", -F.col("page"))).alias("s")).select("doc_id", F.col("s.page").alias("best_page"), F.array_join("s.names", ",").alias("best_names"), F.col("s.score").alias("score"))


def inherit_schema(pages: DataFrame) -> DataFrame:
    """Pages without a header take the last one before them, at first the dominant one; confidence falls by a tenth."""
    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    names = F.array_join("names", ",")
    filled = pages.select("doc_id", "page", names.alias("own"), F.last(names, ignorenulls=True).over(before).alias("carried"))
    return filled.join(dominant_schema(pages), "doc_id", "left").select("doc_id", "page", F.coalesce("own", "carried", "best_names").alias("names"), F.when(F.col("own").isNotNull(), 1.0).otherwise(0.9).alias("confidence"))


#: Cells of a page for joins of what is near: as wide as values are sought, and about a line high.
CELL_X, CELL_Y = 400.0, 16.0


def near_right(tokens: DataFrame, labels: DataFrame, also: tuple[str, ...] = (), reach: float = 350.0) -> DataFrame:
    """Each label (doc_id, page, tok, x1, y0, y1) with each token right of it on its line: columns of tokens, and label.

    Pages are cut into cells: a token lies in one, a label looks into the few that its
    reach touches. So the join is on equal cells, not on all pairs of a page.
    """
    middle = (F.col("y0") + F.col("y1")) / 2
    tall = F.greatest(F.lit(8.0), F.col("y1") - F.col("y0")) * 0.85
    cells = lambda a, b, size: F.explode(F.sequence(F.floor(a / size), F.floor(b / size)))
    lab = labels.select("doc_id", "page", *also, F.col("tok").alias("label"), F.col("x1").alias("lx1"), middle.alias("ly"), tall.alias("lh"))
    lab = lab.withColumn("cx", cells(F.col("lx1") - 2, F.col("lx1") + reach, CELL_X)).withColumn("cy", cells(F.col("ly") - F.col("lh"), F.col("ly") + F.col("lh"), CELL_Y))
    placed = tokens.withColumn("cx", F.floor(F.col("x0") / CELL_X)).withColumn("cy", F.floor(middle / CELL_Y))
    near = placed.join(lab, ["doc_id", "page", *also, "cx", "cy"])
    return near.where((F.col("tok") != F.col("label")) & F.col("x0").between(F.col("lx1") - 2, F.col("lx1") + reach) & (F.abs(middle - F.col("ly")) <= F.col("lh"))).drop("cx", "cy", "lx1", "ly", "lh")


def values_right_of(tokens: DataFrame, labels: DataFrame, reach: float = 350.0, most: int = 3) -> DataFrame:
    """Up to ``most`` tokens right of each label on its line, from left to right."""
    ranked = near_right(tokens, labels, reach=reach).withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "page", "label").orderBy("tok"))).where(F.col("k") <= most)
    return ranked.groupBy("doc_id", "page", "label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "tok", "text"))), lambda t: t["text"]), " ").alias("value"))


def _anchors(ordered: Column, tolerance: float) -> Column:
    """Anchor of each of a page's tokens, which are in order of height."""
    state = F.struct(F.lit(None).cast("double").alias("anchor"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        anchor = F.when(acc["anchor"].isNotNull() & (F.abs(t["y0"] - acc["anchor"]) <= tolerance), acc["anchor"]).otherwise(F.floor(t["y0"]).cast("double"))
        return let(anchor, lambda a: F.struct(a.alias("anchor"), F.array_append(acc["out"], a).alias("out")))

    return F.aggregate(ordered, state, step)["out"]


def bucketed(tokens: DataFrame, tolerance: float = 8.0) -> DataFrame:
    """Tokens with the anchor of their line: tokens by height, a new anchor (whole points) where the last one is farther than ``tolerance``. Their other columns go along, so that nothing is joined."""
    others = [c for c in tokens.columns if c not in ("doc_id", "page", "y0", "x0", "tok")]
    pages = tokens.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "tok", *others))).alias("__t"))
    pages = pages.select("doc_id", "page", "__t", _anchors(F.col("__t"), tolerance).alias("__a"))
    rows = pages.select("doc_id", "page", F.explode(F.arrays_zip("__t", "__a")).alias("r"))
    return rows.select("doc_id", "page", *[F.col(f"r.__t.{c}").alias(c) for c in tokens.columns if c not in ("doc_id", "page")], F.col("r.__a").alias("anchor"))


def bucket_rows(tokens: DataFrame, tolerance: float = 8.0) -> DataFrame:
    """Anchor of each token's line (``bucketed``)."""
    return bucketed(tokens.select("doc_id", "page", "tok", "x0", "y0"), tolerance).select("doc_id", "page", F.col("tok").cast("long").alias("tok"), "anchor")


def page_text(tokens: DataFrame, tolerance: float = 6.0) -> DataFrame:
    """Text of each page, a line a bucket of tops (``bucket_rows``), from left to right: what document evidence reads of tokens."""
    lines = tokens.join(bucket_rows(tokens, tolerance), ["doc_id", "page", "tok"]).groupBy("doc_id", "page", "anchor").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "tok", "text"))), lambda t: t["text"]), " ").alias("line"))
    return lines.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("anchor", "line"))), lambda r: r["line"]), "\n").alias("raw_text"))


def _ranked(starts: Column, down: bool = False) -> Column:
    """Place of each line (from 1) when lines are in order of ``starts``; the one made first goes first among equals."""
    order = F.transform(F.array_sort(F.transform(starts, lambda v, k: F.struct((-v if down else v).alias("v"), k.alias("k")))), lambda o: o["k"])
    return F.transform(starts, lambda _, k: F.array_position(order, k))


def _numbered(tokens: DataFrame, order: list[str], state: Column, step: Callable[[Column, Column], Column], down: bool = False) -> DataFrame:
    """Line number of each token: a fold over a page's tokens in ``order`` whose state has ``tops`` of the lines and ``at``, the line of each token so far."""
    page = F.array_sort(F.collect_list(F.struct(*order, *[c for c in ("tok", "x0", "y0", "y1") if c not in order])))
    folded = tokens.groupBy("doc_id", "page").agg(page.alias("toks")).withColumn("done", F.aggregate("toks", state, step)).withColumn("place", _ranked(F.col("done.tops"), down))
    spread = folded.select("doc_id", "page", F.posexplode("toks").alias("i", "t"), "done.at", "place")
    return spread.select("doc_id", "page", "t.tok", F.get("place", F.get("at", F.col("i"))).alias("row"))


def cluster_rows(tokens: DataFrame, overlap: float = 0.35, near: float = 3.5) -> DataFrame:
    """Row number of each token: the row it fits whose middle is nearest, else a new one; rows grow as they gather.

    A token fits a row if they share ``overlap`` of the lower one's height (6 points
    at least) or their middles are ``near``.
    """
    middle = lambda a, b: (a + b) / 2
    tall = lambda a, b: F.greatest(b - a, F.lit(6.0))
    state = F.struct(F.array().cast("array<double>").alias("tops"), F.array().cast("array<double>").alias("ends"), F.array().cast("array<int>").alias("at"))

    def step(acc: Column, t: Column) -> Column:
        top, end = t["y0"], t["y1"]
        boxes = F.arrays_zip(acc["tops"], acc["ends"])
        away = F.transform(boxes, lambda r: F.abs(middle(top, end) - middle(r["tops"], r["ends"])))
        shared = F.transform(boxes, lambda r: F.greatest(F.least(end, r["ends"]) - F.greatest(top, r["tops"]), F.lit(0.0)) / F.least(tall(top, end), tall(r["tops"], r["ends"])))
        fits = F.filter(F.transform(F.arrays_zip(away.alias("away"), shared.alias("shared")), lambda m, k: F.struct(m["away"].alias("away"), k.alias("k"), ((m["shared"] >= overlap) | (m["away"] <= near)).alias("fits"))), lambda m: m["fits"])

        def joined(k: Column) -> Column:
            grown = lambda side, merge, v: F.when(k.isNull(), F.array_append(acc[side], v)).otherwise(F.transform(acc[side], lambda old, j: F.when(j == k, merge(old, v)).otherwise(old)))
            return F.struct(grown("tops", F.least, top).alias("tops"), grown("ends", F.greatest, end).alias("ends"), F.array_append(acc["at"], F.coalesce(k, F.size(acc["tops"]))).alias("at"))

        return let(F.array_min(fits)["k"], joined)

    return _numbered(tokens, ["y0", "x0", "tok"], state, step)


def anchored_rows(tokens: DataFrame, tolerance: float, moving: bool, down: bool = False) -> DataFrame:
    """Row number of each token in reading order: the first row whose anchor is within ``tolerance`` of its top, else a new one.

    A ``moving`` anchor falls to the least top of its row. Rows are counted from the
    least anchor up, or ``down`` from the greatest (pages with the origin below).
    """
    state = F.struct(F.array().cast("array<double>").alias("tops"), F.array().cast("array<int>").alias("at"))

    def step(acc: Column, t: Column) -> Column:
        near = F.filter(F.transform(acc["tops"], lambda v, k: F.when(F.abs(v - t["y0"]) <= tolerance, k)), lambda k: k.isNotNull())

        def joined(k: Column) -> Column:
            lower = F.transform(acc["tops"], lambda v, j: F.when(j == k, F.least(v, t["y0"])).otherwise(v)) if moving else acc["tops"]
            return F.struct(F.when(k.isNull(), F.array_append(acc["tops"], t["y0"])).otherwise(lower).alias("tops"), F.array_append(acc["at"], F.coalesce(k, F.size(acc["tops"]))).alias("at"))

        return let(F.get(near, 0), joined)

    return _numbered(tokens, ["tok"], state, step, down)


def row_slices(tokens: DataFrame) -> DataFrame:
    """Rows of a table: tops within 5 points, anchors that fall."""
    return anchored_rows(tokens, 5.0, moving=True)


def visual_lines(tokens: DataFrame) -> DataFrame:
    """Lines of a page whose origin is below: baselines within 3.5 points of the line's first."""
    return anchored_rows(tokens, 3.5, moving=False, down=True)


def reading_order(tokens: DataFrame, tolerance: float = 3.5) -> DataFrame:
    """Place of each token (from 1): lines from the top, a line from the left. Tops that follow one another within ``tolerance`` are one line."""
    by_top = Window.partitionBy("doc_id", "page").orderBy("y0", "x0", "tok")
    cut = tokens.withColumn("cut", F.when(F.col("y0") - F.lag("y0").over(by_top) <= tolerance, 0).otherwise(1))
    lines = cut.withColumn("line", F.sum("cut").over(by_top))
    return lines.select("doc_id", "page", "tok", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("line", "x0", "tok")).cast("long").alias("place"))


def join_decimals(cells: DataFrame, gap: float = 6.0) -> DataFrame:
    """Whole number and two digits that stand close in one cell (doc_id, page, row, column, tok, text, x0, x1) become one amount, pairs from left to right."""
    ordered = F.array_sort(F.collect_list(F.struct("x0", "x1", "text")))
    state = F.struct(F.lit(None).cast("double").alias("x1"), F.lit("").alias("text"), F.array().cast("array<string>").alias("out"))
    whole, two = r"^\d{1,3}(,\d{3})*$", r"^\d{2}$"

    def step(acc: Column, t: Column) -> Column:
        away = t["x0"] - acc["x1"]
        joins = F.coalesce((away >= 0) & (away <= gap), F.lit(False)) & F.regexp_replace(acc["text"], r"[₹$€£¥\s]", "").rlike(whole) & F.trim(t["text"]).rlike(two)
        waiting = F.when(acc["x1"].isNotNull(), F.array_append(acc["out"], acc["text"])).otherwise(acc["out"])
        done = F.array_append(acc["out"], F.concat(acc["text"], F.lit("."), t["text"]))
        return F.struct(F.when(~joins, t["x1"]).alias("x1"), F.when(joins, "").otherwise(t["text"]).alias("text"), F.when(joins, done).otherwise(waiting).alias("out"))

    finish = lambda acc: F.when(acc["x1"].isNotNull(), F.array_append(acc["out"], acc["text"])).otherwise(acc["out"])
    return cells.groupBy("doc_id", "page", "row", "column").agg(F.array_join(F.aggregate(ordered, state, step, finish), " ").alias("cell"))


def to_points(boxes: DataFrame, pad: float, width: float, height: float, scale_x: float, scale_y: float) -> DataFrame:
    """Pixel boxes of a padded image to page points: unpad, clamp, scale, two decimals."""
    x = lambda c: F.round(F.greatest(F.lit(0.0), F.least(F.lit(width), F.col(c) - pad)) * scale_x, 2).alias(c)
    y = lambda c: F.round(F.greatest(F.lit(0.0), F.least(F.lit(height), F.col(c) - pad)) * scale_y, 2).alias(c)
    return boxes.select(*[c for c in boxes.columns if c not in ("x0", "x1", "y0", "y1")], x("x0"), y("y0"), x("x1"), y("y1"))


# Words of a table header.
HEADER_WORDS = {"what": ["particulars", "description", "narration", "details", "remarks"], "date": ["date"], "money": ["debit", "credit", "dr", "cr", "withdrawal", "deposit", "paid out", "paid in", "amount"], "balance": ["balance"]}
# How summary and footer rows begin.
FOOTER = r"^(?:total\s+(?:withdrawals?|deposits?|debit|credit|transactions?)[\s:.\-_]*[₹$€]?\s*[\d,.]+|(?:closing|opening|beginning|ending)\s+balance[\s:.\-_]*[₹$€]?\s*[\d,.]+|opening\s+balance\s*[-–—\s]+[\d,.]+|account\s+summary|statement\s+summary|(?:carried\s+forward|brought\s+forward|b/f|c/f)[\s:.\-_]*[₹$€]?\s*[\d,.]+|page\s+\d+\s+of\s+\d+|page\s+no[\s:.]*\d+|generated\s+on|statement\s+generated\s+on|computer\s+generated\s+statement|registered\s+office|branch\s+address|gstin|micr\s+code|end\s+of\s+statement|important\s+information|terms\s+and\s+conditions|step\s+into\s+the|enjoy\s+unlimited|kotak811)"


def row_kind(text: Column) -> Column:
    """HEADER for a repeated table header, FOOTER for summary and notice lines, else ROW."""
    low = F.lower(F.trim(text))

    def has(k: str) -> Column:
        found = low.contains(HEADER_WORDS[k][0])
        for w in HEADER_WORDS[k][1:]:
            found = found | low.contains(w)
        return found

    header = has("what") & (has("money") | has("balance"))
    return F.when(header, "HEADER").when(low.rlike(FOOTER), "FOOTER").otherwise("ROW")


#: What happens to a row of a ledger page.
ACTIONS = ["ACCEPTED_DATE_ROW", "ACCEPTED_SAME_DAY_ROW", "MERGED_AMOUNT_ROW", "MERGED_CONTINUATION_ROW", "REJECTED_UNATTACHED_AMOUNT", "REJECTED_UNATTACHED_TEXT"]
REMOVED = {"HEADER": "HEADER_ROW_REMOVED", "FOOTER": "NON_TRANSACTION_ROW_REMOVED"}
#: A currency amount inside a narration.
EMBEDDED = r"([₹$€]?\s*\d{1,3}(?:,\d{3})*(?:\.\d{2}))"


def reconstruct(rows: DataFrame) -> DataFrame:
    """Ledger rows (doc_id, seq, d, description, debit_raw, credit_raw, balance_raw; optional amount_raw, dr_cr_raw, page, row_text) with an action, the number of the draft they belong to and its date.

    A dated row opens a draft. A row with money or a balance opens a same-day
    draft if the open one has both, else fills its blanks. Plain text extends the
    open draft. What has nothing to attach to is rejected; headers and footers (by
    ``row_text``) are removed. The automaton's states: no draft (0), else 1, and 1
    more if the draft has an amount, and 2 more if a balance is printed.
    """
    blank = F.lit("")
    rows = rows.select("*", *[kind.alias(c) for c, kind in (("amount_raw", blank), ("dr_cr_raw", blank), ("page", F.lit(1).cast("long")), ("row_text", F.lit(None).cast("string"))) if c not in rows.columns])
    positive = lambda c: F.coalesce(clean_amount(F.col(c)) > 0, F.lit(False))
    amount, printed = positive("debit_raw") | positive("credit_raw") | positive("amount_raw"), F.coalesce(F.trim("balance_raw") != "", F.lit(False))
    has = F.when(amount, 1).otherwise(0) + F.when(printed, 2).otherwise(0)
    money = amount | clean_amount(F.col("balance_raw")).isNotNull()
    kind = F.when(F.col("row_text").isNull(), "ROW").otherwise(row_kind(F.col("row_text")))
    # 0: changes nothing; 1 to 4: dated; 5 to 7: money without a date.
    marked = rows.withColumn("kind", kind).withColumn("move", F.when(F.col("kind") != "ROW", 0).when(F.col("d").isNotNull(), has + 1).when(money, has + 4).otherwise(0))

    def step(s: Column, r: Column) -> Column:
        return F.when(r["move"] == 0, s).when(r["move"] < 5, r["move"]).when(s == 0, 0).when(s == 4, r["move"] - 3).otherwise((s - 1).bitwiseOR(r["move"] - 4) + 1)

    opened = lambda s, move: move.between(1, 4) | ((move > 4) & (s == 4))
    dated = F.when((F.col("kind") == "ROW") & F.col("d").isNotNull(), F.col("d"))
    known = transducer(marked.withColumn("dated", dated), "doc_id", "seq", 5, step, {"segment": lambda s, r: F.when(opened(s, r["move"]), 1).otherwise(0)}, {"date": ("date", lambda s, r: r["dated"])})
    opens, attached = opened(F.col("before"), F.col("move")), F.col("before") > 0
    action = (
        F.when(F.col("kind") == "HEADER", REMOVED["HEADER"]).when(F.col("kind") == "FOOTER", REMOVED["FOOTER"]).when(F.col("move").between(1, 4), ACTIONS[0]).when(opens, ACTIONS[1])
        .when(F.col("move") > 4, F.when(attached, ACTIONS[2]).otherwise(ACTIONS[4])).otherwise(F.when(attached, ACTIONS[3]).otherwise(ACTIONS[5]))
    )
    out = known.withColumn("action", action)
    return out.select("doc_id", "seq", "page", "segment", "action", "date", "description", "debit_raw", "credit_raw", "amount_raw", "dr_cr_raw", "balance_raw")


def audit(actions: DataFrame) -> DataFrame:
    """Rows of each document by action; headers and footers are candidates too."""
    return actions.groupBy("doc_id").agg(F.count("*").alias("candidates"), *[F.count_if(F.col("action") == n).alias(n.lower()) for n in [*ACTIONS, *REMOVED.values()]])


def audit_pages(actions: DataFrame, transactions: DataFrame) -> DataFrame:
    """Rows by action, and finished transactions, of each page of a document."""
    counts = actions.groupBy("doc_id", "page").agg(F.count("*").alias("candidates"), *[F.count_if(F.col("action") == n).alias(n.lower()) for n in [*ACTIONS, *REMOVED.values()]])
    done = transactions.groupBy("doc_id", "page").agg(F.count("*").alias("transactions"))
    return counts.join(done, ["doc_id", "page"], "left").withColumn("transactions", F.coalesce("transactions", F.lit(0)))


def finalize(actions: DataFrame) -> DataFrame:
    """Transactions of drafts: blanks filled from later money rows, narration joined; drafts without an amount go.

    The amount is the debit, else the credit, else the general amount, else one inside
    the narration; the last two get their side from the balance of the transaction
    before, the column of sides, marks and words. An amount of which one printed
    character differs from what the balances imply on its side is corrected.
    """
    kept = actions.where("segment > 0").where(F.col("action").isin(ACTIONS[:4]))
    filled = lambda c: F.when((F.col("action") != ACTIONS[3]) & (F.nullif(F.col(c), F.lit("")).isNotNull()), F.col("seq"))
    first = lambda c: F.min_by(c, filled(c)).alias(c)
    words = F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("seq", "description"))), lambda r: r["description"]), lambda x: x != ""), " ")
    g = kept.groupBy("doc_id", "segment").agg(F.min("date").alias("d"), F.min_by("page", "seq").alias("page"), *map(first, ("debit_raw", "credit_raw", "amount_raw", "dr_cr_raw", "balance_raw")), F.trim(words).alias("description"))
    inside = F.nullif(F.regexp_extract("description", EMBEDDED, 1), F.lit(""))
    value = {c: clean_amount(F.col(f"{c}_raw")) for c in ("debit", "credit", "amount", "balance")}
    typed = g.select("*", *[v.alias(c) for c, v in value.items()], inside.alias("inside"))
    sided = F.when(F.col("debit") > 0, F.struct(F.lit("DEBIT").alias("type"), F.col("debit").alias("a"), F.lit(None).cast("string").alias("raw"))).when(F.col("credit") > 0, F.struct(F.lit("CREDIT").alias("type"), F.col("credit").alias("a"), F.lit(None).cast("string").alias("raw")))
    open_ = lambda c, raw: F.struct(F.lit(None).cast("string").alias("type"), c.alias("a"), raw.alias("raw"))
    chosen = F.coalesce(sided, F.when(F.col("amount") > 0, open_(F.col("amount"), F.col("amount_raw"))), F.when(clean_amount(F.col("inside")) > 0, open_(clean_amount(F.col("inside")), clean_amount(F.col("inside")).cast("string"))))
    some = typed.withColumn("chosen", chosen).where("chosen is not null")
    before = Window.partitionBy("doc_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    rows = some.drop("debit", "credit", "amount").select("*", F.last("balance", ignorenulls=True).over(before).alias("prev_balance"), F.col("chosen.raw").alias("raw"), F.col("dr_cr_raw").alias("column_type"))
    t = classify_side(rows).drop("amount").withColumn("type", F.coalesce("chosen.type", "side")).withColumn("read", F.col("chosen.a").cast(MONEY))
    change = (F.col("balance") - F.col("prev_balance")).cast(MONEY)
    a, b = F.col("read").cast("string"), F.abs(change).cast(MONEY).cast("string")
    differing = F.size(F.filter(F.sequence(F.lit(1), F.length(a)), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))
    right_way = ((F.col("type") == "DEBIT") & (change < 0)) | ((F.col("type") == "CREDIT") & (change > 0))
    fix = F.coalesce(right_way & (F.length(a) == F.length(b)) & (differing == 1), F.lit(False))
    return t.select("doc_id", "segment", "page", "d", F.coalesce(F.nullif("description", F.lit("")), F.lit("Bank Transaction")).alias("description"), "type", F.when(fix, F.abs(change)).otherwise(F.col("read")).cast(MONEY).alias("amount"), "balance", fix.alias("corrected"))


def classify_side(rows: DataFrame) -> DataFrame:
    """Side of amounts (raw, column_type, description, prev_balance, balance): balances, then column, then marks, then narration, then DEBIT."""
    amount, change, low = F.abs(clean_amount(F.col("raw"))), F.col("balance") - F.col("prev_balance"), F.lower("description")
    explains = F.abs(F.abs(change) - amount) <= 0.05
    side = (
        F.when(amount.isNull() | (amount == 0), "DEBIT").when(explains & (change > 0), "CREDIT").when(explains & (change < 0), "DEBIT")
        .when(F.col("column_type").isin("CREDIT", "DEBIT"), F.col("column_type")).when(indicator(F.col("raw")).isNotNull(), indicator(F.col("raw")))
        .when(low.rlike(TYPED_CREDIT), "CREDIT").when(low.rlike(TYPED_DEBIT), "DEBIT").otherwise("DEBIT")
    )
    return rows.select("*", side.alias("side"), F.coalesce(amount, F.lit(0)).cast(MONEY).alias("amount"))


# Words of a narration that tell its side, credits first.
CREDIT_WORDS = r"\b(SALARY|CREDITED|CREDIT|CR\b|BY\s+TRANSFER|INWARD|RECEIVED|REFUND|REVERSAL|CASH\s+DEP|SELF\s+CASH\s+DEP|BNA/|INTEREST|INT\.PD|DEPOSIT|REV-UPI)\b"


def infer_side(narration: Column, hint: Column) -> Column:
    """The column's side if known, CREDIT by the narration's words, else DEBIT."""
    return F.coalesce(hint, F.when(F.upper(narration).rlike(CREDIT_WORDS), "CREDIT"), F.lit("DEBIT"))


def resolve_line_amounts(lines: DataFrame, opening: float | None = None, tolerance: float = 0.05, keep: tuple[str, ...] = (), by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Transactions (doc_id, seq, description, amounts; hint: side of the column; reset: a balance stated just before, if known) to type, amount, balance, continuous and ambiguous; columns of ``keep`` stay. Rows alike in ``by`` are one ledger.

    The last of two amounts or more is the balance. Which side an amount is on, and
    which of several it is, follows from the balance before; else from the words. A
    row with one amount moves the balance, one with none keeps it. So the balance is
    the last stated one and what single amounts added since: a running sum.
    """
    order = Window.partitionBy(*by).orderBy("seq")
    given = lambda c, kind: F.col(c).cast(kind) if c in lines.columns else F.lit(None).cast(kind)
    rows = lines.select("doc_id", "seq", *keep, infer_side(F.col("description"), given("hint", "string")).alias("guess"), F.transform("amounts", lambda a: a.cast(MONEY)).alias("a"), given("reset", MONEY).alias("reset")).withColumn("n", F.size("a"))
    rows = rows.withColumn("stated", F.when(F.col("n") >= 2, F.element_at("a", -1)))
    rows = rows.withColumn("move", F.when(F.col("n") == 1, F.get("a", 0) * F.when(F.col("guess") == "CREDIT", 1).otherwise(-1)).otherwise(0)).withColumn("moved", F.sum("move").over(order))
    first = F.lit(opening).cast(MONEY)
    level = F.coalesce(F.col("stated") - F.col("moved"), F.col("reset") - F.col("moved") + F.col("move"))
    rows = rows.withColumn("balance", (F.coalesce(F.last(level, ignorenulls=True).over(order), first) + F.col("moved")).cast(MONEY))
    rows = rows.withColumn("prev", F.coalesce("reset", F.lag("balance").over(order), first))
    change, near = F.col("stated") - F.col("prev"), F.lit(tolerance).cast(MONEY)
    up, down = (lambda x: F.abs(change - x) <= near), (lambda x: F.abs(change + x) <= near)
    # Of two amounts the first, whatever its sign; of more the last positive one that explains the change.
    fits = F.filter(F.reverse(F.slice("a", 1, F.greatest(F.col("n") - 1, F.lit(0)))), lambda x: ((F.col("n") == 2) | (x > 0)) & (up(x) | down(x)))
    rows = rows.withColumn("fit", F.get(fits, 0))
    one, two, guess = F.get("a", 0), F.get("a", 1), F.col("guess")
    either = F.when((one > 0) & (two == 0), "DEBIT").when((two > 0) & (one == 0), "CREDIT")
    chosen = F.when(guess == "CREDIT", F.coalesce(F.nullif(two, F.lit(0)), one)).otherwise(F.coalesce(F.nullif(one, F.lit(0)), two))
    known = F.col("prev").isNotNull()
    moved_side = F.when(change > 0, "CREDIT").when((change < 0) | (F.col("n") > 2), "DEBIT").otherwise(guess)
    side = F.when(F.col("n") == 0, "DEBIT").when(F.col("n") == 1, guess).when(F.col("fit").isNotNull(), F.when(up(F.col("fit")), "CREDIT").otherwise("DEBIT")).when(known, moved_side).when(F.col("n") == 2, guess).otherwise(F.coalesce(either, guess))
    amount = F.when(F.col("n") == 0, 0).when(F.col("n") <= 2, one).when(F.col("fit").isNotNull(), F.col("fit")).when(known, F.get("a", F.col("n") - 2)).otherwise(F.when(either == "DEBIT", one).when(either == "CREDIT", two).otherwise(chosen))
    holds = F.when(F.col("n") == 0, False).when(F.col("n") == 1, True).when(known, F.col("fit").isNotNull()).otherwise((F.col("n") == 2) | either.isNotNull())
    unsure = (F.col("n") == 0) | ((F.col("n") == 2) & known & F.col("fit").isNull() & (change == 0)) | ((F.col("n") > 2) & ~known & either.isNull())
    return rows.select("doc_id", "seq", *keep, side.alias("type"), amount.cast(MONEY).alias("amount"), "balance", holds.alias("continuous"), F.coalesce(unsure, F.lit(False)).alias("ambiguous"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Statement lines (doc_id, seq, line) to transactions' text and amounts: a dated line starts one, later lines extend it, money is what looks like it."""
    from ..functions import dates

    money = r"(?<![\d.])(\d+(?:,\d+)*\.\d{2})(?![\d.])"
    dated = r"^\s*(?:\d{1,4}\s+)?(\d{1,2}[-/. ](?:\d{1,2}|[A-Za-z]{3})[-/. ]\d{2,4})\b"
    body = lines.where(~F.col("line").rlike(r"(?i)\b(transaction\s+total|grand\s+total|total\s+debit|total\s+credit|closing\s+balance)\b") & (row_kind(F.col("line")) == "ROW"))
    day = F.when(F.col("line").rlike(dated), dates.parse(F.regexp_extract("line", dated, 1)))
    cut = body.select("doc_id", "seq", day.alias("day"), F.regexp_replace("line", r"^\s*\d{5,8}\s+(?=[\d,]+\.\d{2})", "").alias("line"))
    numbered = cut.withColumn("segment", F.sum(F.when(F.col("day").isNotNull(), 1).otherwise(0)).over(Window.partitionBy("doc_id").orderBy("seq"))).where("segment > 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda r: r["line"]), " ")
    joined = numbered.groupBy("doc_id", F.col("segment").alias("seq")).agg(F.min("day").alias("d"), text.alias("all"))
    amounts = F.transform(F.regexp_extract_all("all", F.lit(money), 1), lambda a: F.translate(a, ",", "").cast("double"))
    words = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("all", dated, ""), money, ""), r"\s{2,}", " "))
    return joined.select("doc_id", "seq", "d", words.alias("description"), amounts.alias("amounts"))
