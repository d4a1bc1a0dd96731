"""Predicates and normal forms of statement texts, as column expressions; text columns may be null and count as empty."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import exprs as X
from ledgerloom.functions import lexicon as L
from ledgerloom.functions.exprs import MONEY


def text(*cols: str | Column) -> Column:
    """The columns joined by blanks, null as empty."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in cols])


def let(value: Column, body) -> Column:
    """body(value) with value worked out once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def has_any(c: Column, words: list[str]) -> Column:
    return c.rlike("|".join(re.escape(w) for w in words))


def first_of(pairs: list[tuple[Column, Column | str]], default: Column) -> Column:
    """The value of the first (condition, value) that holds."""
    return reduce(lambda rest, p: F.when(p[0], p[1]).otherwise(rest), reversed(pairs), default)


def party_name(name: Column, merchants: list[tuple[str, str]] | None = None) -> Column:
    """A counterparty's normal form: platform prefix off, known merchants by the name they go by, then letters, digits and Chinese characters alone.

    A merchant fits if its key is in the name or the name in the key. merchants replaces the table, as a configuration may.
    """
    bare = F.regexp_replace(F.trim(name), "^(?:" + "|".join(map(re.escape, L.PLATFORM_PREFIXES)) + ")", "")
    kept = F.regexp_replace(bare, "[^一-龥a-zA-Z0-9]", "")
    known = lambda low: first_of([(F.contains(low, F.lit(k)) | F.contains(F.lit(k), low), F.lit(v)) for k, v in (L.MERCHANTS if merchants is None else merchants)], F.lit(None).cast("string"))
    found = F.coalesce(let(F.lower(bare), known), F.when(kept == "", L.UNKNOWN_PARTY).otherwise(kept))
    return F.when(F.coalesce(name, F.lit("")) == "", L.UNKNOWN_PARTY).otherwise(found)


def bank_party(name: Column) -> Column:
    """A bank row's counterparty without rail prefixes and a card suffix in brackets at the end."""
    bare = reduce(lambda c, p: F.regexp_replace(c, "^" + re.escape(p), ""), L.BANK_PREFIXES, name)
    return F.when(F.coalesce(name, F.lit("")) == "", L.UNKNOWN_PARTY).otherwise(F.trim(F.regexp_replace(bare, r"\(\d+\)$", "")))


def transaction_type(platform: str, said: Column, direction: Column | None = None, amount: Column | None = None) -> Column:
    """REFUND, TRANSFER, INCOME, EXPENSE or UNKNOWN from a row's words, then from its direction, or for UnionPay its sign."""
    refund, transfer = L.TYPE_WORDS[platform]
    if platform == "wechat":
        rest = [(F.contains(said, F.lit("二维码收款")), "INCOME"), (F.contains(said, F.lit("扫二维码付款")), "EXPENSE")]
    elif platform == "unionpay":
        rest = [(amount > 0, "INCOME"), (amount < 0, "EXPENSE")]
    else:
        rest = [(direction == "收入", "INCOME"), (direction == "支出", "EXPENSE")]
    return first_of([(has_any(said, refund), F.lit("REFUND")), (has_any(said, transfer), F.lit("TRANSFER")), *[(c, F.lit(v)) for c, v in rest]], F.lit("UNKNOWN"))


def unionpay_amount(amount: Column, kind: Column) -> Column:
    """UnionPay amounts are unsigned: spending words make them negative, then receiving words positive, else they are spending."""
    return first_of([(has_any(kind, L.UNIONPAY_OUT), -F.abs(amount)), (has_any(kind, L.UNIONPAY_IN), F.abs(amount))], -F.abs(amount)).cast(MONEY)


def is_transfer(source: Column, said: Column) -> Column:
    """Whether a platform's words call the row a transfer between own accounts."""
    return reduce(lambda a, b: a | b, [(source == s) & has_any(said, w) for s, w in L.TRANSFER_WORDS.items()])


def source_id(source: Column) -> Column:
    """A source's name, trimmed and lower-cased; a blank one is null."""
    return F.nullif(F.lower(F.trim(source)), F.lit(""))


def signed_amount(amount: Column, direction: Column) -> tuple[Column, Column]:
    """(amount, direction) in the strict form: all but digits, dots and minus go, spending is negative; null where either can't be read."""
    way = first_of([(direction == k, F.lit(v)) for k, v in L.DIRECTIONS.items()], F.lit(None).cast("string"))
    size = F.abs(F.regexp_replace(amount, r"[^0-9.\-]", "").try_cast(MONEY))
    return F.when(way == "expense", -size).when(way.isNotNull(), size).cast(MONEY), way


def decimal_amount(c: Column) -> Column:
    """The last number with two decimals in a text, blanks left out, else null."""
    tokens = F.regexp_extract_all(F.regexp_replace(c, r"\s", ""), F.lit(r"[+-]?\d[\d,]*\.\d{2}"), F.lit(0))
    return F.regexp_replace(F.try_element_at(tokens, F.lit(-1)), ",", "").try_cast(MONEY)


def strict_datetime(c: Column) -> Column:
    """Date and time with dashes or slashes, also where the blank between them is lost or odd characters came in; else null."""
    compact = F.regexp_replace(c, r"[^0-9/\-:]", "")
    repaired = F.when(compact.rlike(r"^\d{4}[-/]\d{2}[-/]\d{4}:\d{2}:\d{2}$"), F.concat(F.substring(compact, 1, 10), F.lit(" "), F.substring(compact, 11, 8)))
    return F.coalesce(*[X.try_stamp(x, f) for x in (c, repaired) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss")]).cast("timestamp_ntz")


def cell(c: Column) -> Column:
    """A cell's text, trimmed; null and the marks for blank are empty."""
    plain = F.trim(F.coalesce(c, F.lit("")))
    return F.when(plain.isin(L.BLANK_MARKERS), "").otherwise(plain)


def strip_bom(c: Column) -> Column:
    """Text without marks and invisible characters at its start."""
    return F.regexp_replace(c, r"^[\x{FEFF}\x{FFFE}\x{00A0}\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{2000}-\x{200F}\x{2028}-\x{202F}\x{205F}-\x{206F}\x{3000}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}]+", "")


def refund_words(said: Column) -> Column:
    return has_any(F.lower(said), L.REFUND_WORDS)


def merchant_core(name: Column) -> Column:
    """A merchant without refund and company words, marks and case."""
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "(?U)" + "|".join(L.REFUND_NOISE) + r"|[\W_]", "")


def cores_match(a: Column, b: Column) -> Column:
    """Whether of two merchant cores, of two characters at least, one holds the other."""
    return (F.char_length(a) >= 2) & (F.char_length(b) >= 2) & (F.contains(a, b) | F.contains(b, a))


def merchant_tokens(said: Column) -> Column:
    """Known merchants named in a text and its character pairs. A shared longer run shares its pairs, so pairs are enough to compare."""
    low = F.lower(said)
    named = F.array_compact(F.array(*[F.when(has_any(low, names), F.lit(k)) for k, names in L.MERCHANT_ALIASES.items()]))
    plain = F.regexp_replace(low, "(?U)" + "|".join(L.TOKEN_NOISE) + r"|[\W_]", "")
    return F.array_distinct(F.concat(named, let(plain, pairs_of)))


def pairs_of(plain: Column) -> Column:
    """Neighbouring characters of a text; a text of one has none."""
    n = F.char_length(plain)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(plain, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def bank_families(method: Column) -> Column:
    """The banks that a payment method names, by any of their names."""
    low = F.lower(F.coalesce(method, F.lit("")))
    return F.array_compact(F.array(*[F.when(has_any(low, names), F.lit(k)) for k, names in L.BANK_FAMILIES.items()]))


def payment_rail(said: Column) -> Column:
    """The wallet that a bank row's words name, else null."""
    low = F.lower(said)
    return first_of([(has_any(low, words), F.lit(rail)) for rail, words in L.RAILS], F.lit(None).cast("string"))


def is_internal_product(said: Column) -> Column:
    return has_any(F.lower(said), L.INTERNAL_PRODUCTS)


def account_by_alias(said: Column, accounts: list[tuple[str, list[str]]]) -> Column:
    """The first account one of whose names is in the text, else null. The names, card suffixes among them, are the user's own table."""
    low = F.lower(said)
    return first_of([(has_any(low, [n.lower() for n in names]), F.lit(account)) for account, names in accounts], F.lit(None).cast("string"))


def wallet_effect(source: Column, amount: Column, direction: Column, method: Column, said: Column, status: Column, bank_part: Column) -> tuple[Column, Column]:
    """(effect, reason) of a row on its wallet's balance; a null effect is none. bank_part: what a bank paid of a mixed payment, or null."""
    size, method = F.abs(amount), F.coalesce(method, F.lit(""))
    rest = F.greatest(size - bank_part, F.lit(0))
    unbanked = ~has_any(method, ["银行", "卡("])
    cases = [
        ((source == "wechat") & F.contains(said, F.lit("充值完成")), size, "wallet_recharge"),
        ((source == "wechat") & F.contains(said, F.lit("提现已到账")), -size, "wallet_withdrawal"),
        ((source == "wechat") & F.contains(method, F.lit("零钱")), amount, "wallet_funded"),
        ((source == "wechat") & (direction == "income") & method.isin("", "/"), amount, "wallet_income"),
        (source == "wechat", None, "not_wallet_funded"),
        (status == "交易关闭", None, "closed"),
        ((direction == "income") & (method == ""), amount, "wallet_income"),
        (~F.contains(method, F.lit("余额")), None, "not_wallet_funded"),
        (unbanked & (direction == "neutral") & F.contains(said, F.lit("提现")), -size, "wallet_withdrawal"),
        (unbanked, amount, "wallet_funded"),
        (bank_part.isNull(), amount, "mixed_funding_unresolved"),
    ]
    last = F.when(amount < 0, -rest).otherwise(rest)
    effect = first_of([(c, F.lit(None) if v is None else v) for c, v, _ in cases], last).cast(MONEY)
    return effect, first_of([(c, F.lit(r)) for c, _, r in cases], F.lit("mixed_funding_split"))


def same_order(a_orders: Column, b_orders: Column, a_ids: Column, b_ids: Column) -> Column:
    """Whether a refund (a) and a payment (b) share an order number, or the refund's number is the payment's or starts with it and _."""
    begins = F.exists(a_ids, lambda x: F.exists(b_ids, lambda y: (x == y) | F.startswith(x, F.concat(y, F.lit("_")))))
    return F.coalesce(F.arrays_overlap(a_orders, b_orders), F.lit(False)) | F.coalesce(begins, F.lit(False))


def audit_form(c: Column) -> Column:
    """Lower case without any blanks, to compare texts of an audit."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+", "")
