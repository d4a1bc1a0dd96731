"""Accounts of a double-entry ledger from texts, as column expressions; text columns may be null and count as empty.

The tables of keywords for expenses are the user's: (keyword, account) in the order in which they are tried.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.texts import first_of, has_any, let, text

# Words and account names that results depend on.
BANK_CODES = [
    ("招商", "CMB"), ("工行", "ICBC"), ("建行", "CCB"), ("农行", "ABC"), ("中行", "BOC"), ("交通", "BCM"), ("邮储", "PSBC"), ("中信", "CITIC"),
    ("光大", "CEB"), ("华夏", "HXB"), ("民生", "CMBC"), ("广发", "GDB"), ("平安", "PAB"), ("浦发", "SPDB"), ("兴业", "CIB"), ("浙商", "ZSB"),
]
LIKELY_EXPENSE = ["购买", "消费", "支付", "支出", "买", "餐厅", "超市", "地铁", "公交", "打车", "外卖", "美团", "饿了么"]
LIKELY_INCOME = ["工资", "薪资", "奖金", "分红", "利息", "退款", "转入", "收入", "进账", "存入", "充值"]
INCOME_RULES = [
    ("退款", "Income:Refund:Shopping"), ("退回", "Income:Refund:Shopping"), ("refund", "Income:Refund:Shopping"),
    ("工资", "Income:Salary:Gross"), ("薪资", "Income:Salary:Gross"), ("salary", "Income:Salary:Gross"), ("奖金", "Income:Salary:Bonus"), ("年终奖", "Income:Salary:Bonus"), ("绩效", "Income:Salary:Bonus"),
    ("分红", "Income:Investment:Dividend"), ("dividend", "Income:Investment:Dividend"), ("利息", "Income:Investment:Interest"), ("理财", "Income:Investment:Interest"), ("基金", "Income:Investment:Fund"), ("股票", "Income:Investment:CapitalGains"),
]
CATEGORY_WORDS = [
    ("food", ["餐厅", "饭店", "美食", "外卖", "肯德基", "麦当劳", "星巴克", "超市", "便利店", "水果", "生鲜", "饿了么", "美团"]),
    ("transport", ["地铁", "公交", "滴滴", "出租车", "加油", "停车", "高速", "铁路", "航空"]),
    ("shopping", ["京东", "淘宝", "天猫", "拼多多", "唯品会", "苏宁", "商场", "购物中心"]),
    ("entertainment", ["电影", "影院", "游戏", "视频", "音乐", "会员", "爱奇艺", "腾讯", "优酷"]),
    ("medical", ["医院", "药店", "诊所", "体检", "医保"]),
    ("education", ["学校", "培训", "课程", "教材", "考试", "学费"]),
    ("housing", ["房租", "物业", "水电", "燃气", "宽带"]),
    ("communication", ["话费", "流量", "移动", "联通", "电信", "宽带"]),
    ("financial", ["手续费", "利息", "理财", "基金", "保险"]),
]
#: (tag, words of the party as written, words of the lower-cased text), in the order of the tags; a tag may come twice.
TAG_WORDS = [
    ("alipay", ["支付宝"], ["alipay"]), ("wechat", ["微信"], ["wechat"]), ("bank", ["银行"], ["bank"]),
    ("delivery", [], ["外卖", "配送"]), ("delivery", [], ["快递", "配送"]), ("red_packet", [], ["红包"]), ("topup", [], ["充值"]),
]
CASH, NO_ASSET, OTHER_INCOME, NO_EXPENSE, NO_INCOME = "Assets:Current:Cash", "Assets:Unknown", "Income:Other", "Expenses:Unknown", "Income:Unknown"


def _none() -> Column:
    return F.lit(None).cast("string")


def first_account(said: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The account of the first rule whose keyword is in said. One pass over a constant list, so long tables stay one expression."""
    if not rules:
        return F.lit(default)
    table = F.array(*[F.struct(F.lit(k.lower()).alias("word"), F.lit(a).alias("account")) for k, a in rules])
    return let(said, lambda t: F.coalesce(F.get(F.filter(table, lambda r: F.contains(t, r["word"])), F.lit(0))["account"], F.lit(default)))


def bank_code(c: Column) -> Column:
    """The code of the first bank named in c, or null."""
    return first_of([(F.contains(c, F.lit(name)), F.lit(code)) for name, code in BANK_CODES], _none())


def asset_account(platform: Column, party: Column, wallets: dict[str, str]) -> Column:
    """The account that money of a platform lies in: wallets names it per platform; a bank's own account where the party names one; else cash."""
    low = F.lower(platform)
    own = [(low == k, F.coalesce(F.concat(F.lit("Assets:Current:Bank:"), bank_code(party)), F.lit(a)) if k == "bank" else F.lit(a)) for k, a in wallets.items()]
    return first_of(own, F.lit(CASH))


def plain_asset_account(platform: Column, method: Column, assets: dict[str, str]) -> Column:
    """The account by platform alone, or for a bank by the bank that the payment method names."""
    own = [(platform == k, F.coalesce(F.concat(F.lit("Assets:Bank:"), bank_code(method)), F.lit(a)) if k == "bank" else F.lit(a)) for k, a in assets.items()]
    return first_of(own, F.lit(NO_ASSET))


def opposing_account(party: Column, description: Column, kind: Column, expense_rules: list[tuple[str, str]]) -> Column:
    """The other side of an entry: by the kind (expense, income) or, without one, by words that make it likely."""
    said = F.lower(text(party, description))
    spent, earned = has_any(said, LIKELY_EXPENSE), has_any(said, LIKELY_INCOME)
    kind = F.coalesce(kind, F.lit(""))
    rules = [
        ((kind == "expense") | ((kind == "") & spent), first_account(said, expense_rules, NO_EXPENSE)),
        ((kind == "income") | earned, first_account(said, INCOME_RULES, OTHER_INCOME)),
        (spent, F.lit(NO_EXPENSE)),
    ]
    return first_of(rules, F.lit(NO_INCOME))


def account_tags(party: Column, description: Column) -> Column:
    """The tags whose words are in the party or the text, in their order."""
    said = F.lower(text(party, description))
    has = lambda c, words: has_any(F.coalesce(c, F.lit("")), words) if words else F.lit(False)
    return F.array_compact(F.array(*[F.when(has(party, own) | has(said, words), tag) for tag, own, words in TAG_WORDS]))


def account_part(account: Column) -> Column:
    """The second part of an account's path, or Unknown."""
    return F.coalesce(F.get(F.split(account, ":"), F.lit(1)), F.lit("Unknown"))


def word_category(party: Column, description: Column) -> Column:
    """The first category with a word in the text, or unknown."""
    said = F.lower(text(party, description))
    return first_of([(has_any(said, words), F.lit(c)) for c, words in CATEGORY_WORDS], F.lit("unknown"))
