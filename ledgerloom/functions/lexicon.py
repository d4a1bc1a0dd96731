"""Word lists and tables that statements and ledgers are read with. Results depend on them and on their order."""

from __future__ import annotations

# Fixed values from here on, as plain text in their natural order.

#: Prefixes that platforms put before a counterparty; the first that fits goes.
PLATFORM_PREFIXES = ["支付宝-", "财付通-", "微信支付-", "微信-", "银联-", "支付宝（中国）网络技术有限公司-", "快钱支付-"]
#: Prefixes that bank rows carry; each is taken off once, in this order.
BANK_PREFIXES = ["支付宝-", "财付通-", "微信支付-", "微信-", "银联-", "网联-", "快钱-"]
#: Names of a merchant and the name it goes by; the first that fits counts.
MERCHANTS = [
    ("starbucks", "星巴克"), ("starbucks coffee", "星巴克"), ("starbucks corporation", "星巴克"), ("星巴克咖啡", "星巴克"),
    ("mcdonalds", "麦当劳"), ("mcdonald's", "麦当劳"), ("麦当劳中国", "麦当劳"), ("麦当劳餐厅", "麦当劳"),
    ("kfc", "肯德基"), ("kentucky fried chicken", "肯德基"),
    ("滴滴", "滴滴出行"), ("didi", "滴滴出行"), ("didi chuxing", "滴滴出行"), ("滴滴快车", "滴滴出行"), ("滴滴专车", "滴滴出行"), ("北京小桔科技", "滴滴出行"),
    ("jd", "京东"), ("jd.com", "京东"), ("京东商城", "京东"), ("taobao", "淘宝"), ("淘宝", "淘宝"), ("浙江淘宝", "淘宝"),
    ("tmall", "天猫"), ("天猫", "天猫"), ("meituan", "美团"), ("美团", "美团"), ("美团点评", "美团"), ("pdd", "拼多多"), ("拼多多", "拼多多"),
]
UNKNOWN_PARTY = "未知"
#: Words that make a row a transfer between a person's own accounts, by platform.
TRANSFER_WORDS = {
    "alipay": ["充值", "提现", "转到余额宝", "信用卡还款", "转账到银行卡", "零钱"],
    "wechat": ["充值", "提现", "零钱通", "信用卡还款"],
    "bank": ["支付宝充值", "财付通充值", "快捷支付退款", "支付宝提现入账", "微信零钱充值", "微信零钱提现"],
}
PRIORITY = [("alipay", 3), ("wechat", 2), ("bank", 1)]
#: Words of the type rules per platform: refund, transfer.
TYPE_WORDS = {
    "alipay": (["退款", "退回"], ["充值", "提现", "转账", "零钱", "余额宝"]),
    "wechat": (["退款", "退还", "退款入账"], ["充值", "提现", "零钱通", "零钱", "转账", "信用卡还款"]),
    "bank": (["退款", "退回", "退款入账", "支付宝提现入账"], ["充值", "提现", "转账", "支付宝", "财付通", "微信零钱"]),
    "unionpay": (["退款", "退回", "退款入账"], ["充值", "提现", "转账", "转入", "转出"]),
}
UNIONPAY_IN = ["收入", "退款", "充值", "转入", "红包", "返还", "退款入账"]
UNIONPAY_OUT = ["支出", "消费", "支付", "转出", "提现", "购买", "缴费"]
REFUND_WORDS = ["退款", "退回", "refund"]
BANK_FAMILIES = {
    "cmb": ["招商银行", "招商", "cmb"], "icbc": ["工商银行", "工行", "icbc"],
    "cqrcb": ["重庆农村商业银行", "重庆农商行", "农村商业银行", "农商行", "cqrcb"],
}
RAILS = [("alipay", ["支付宝", "alipay"]), ("wechat", ["财付通", "微信", "wechat"])]
INTERNAL_PRODUCTS = ["朝朝宝转入", "朝朝宝转出", "理财购买", "理财赎回", "基金购买"]
MERCHANT_ALIASES = {"高德": ["高德"], "滴滴": ["滴滴", "小桔"], "美团": ["美团", "三快"], "饿了么": ["饿了么", "拉扎斯"]}
TOKEN_NOISE = ["有限公司", "有限责任公司", "信息技术", "网络科技", "科技", "支付", "快捷", "消费"]
REFUND_NOISE = ["退款", "退回", "退还", "有限公司", "有限责任公司"]
CANCELLED = ["交易关闭", "已关闭", "交易取消", "已取消", "支付失败", "交易失败", "已退货"]
REFUND_PENDING = ["退款中", "退款处理中", "退款申请中", "对方已退还", "已退款"]
REFUND_DONE = ["退款成功", "已全额退款", "部分退款"]
#: Classification: type, category, words, confidence; the first rule with a word counts.
CLASSES = [
    ("PREAUTHORIZATION", "酒店预授权", ["预授权撤销", "预授权完成", "预授权"], "0.95"),
    ("INVESTMENT", "理财资产转移", ["朝朝宝转入", "朝朝宝转出", "基金赎回", "理财赎回"], "0.92"),
    ("TRANSFER", "信用卡还款", ["信用卡还款", "信用卡自动还款"], "0.95"),
    ("TRANSFER", "账户内部转移", ["零钱充值", "零钱提现", "余额充值", "余额提现", "充值到余额", "提现到银行卡", "转到余额宝", "转出到银行卡", "本人转账", "充值完成", "提现已到账"], "0.96"),
    ("PREAUTHORIZATION", "未发生或已关闭交易", ["交易关闭"], "0.99"),
    ("REFUND", "退款", ["退款成功"], "0.99"),
    ("TRANSFER", "企业支付（非个人收支）", ["因公付"], "0.99"),
]
PRODUCT_CLASS = ("INVESTMENT", "银行内部理财转移", "0.98")
WALLET_TO_BANK = ("TRANSFER", "支付账户与银行卡互转", "0.96")
WALLET_FUNDS = ["余额", "支付宝余额", "微信零钱"]
DIRECTIONS = {"支出": "expense", "收入": "income", "不计收支": "neutral", "/": "neutral"}
UNCATEGORISED = "未分类"
#: Evidence codes and weights of the payment-to-bank matcher, in the order they are listed.
EVIDENCE = {
    "amount_exact": "0.25", "refund_credit_direction": "0.10", "anchored_refund_credit": "0.10", "direction_exact": "0.10", "booking_date_exact": "0.15",
    "booking_date_adjacent": "0.05", "bank_suffix_exact": "0.25", "bank_name_exact": "0.10", "payment_rail_exact": "0.10", "datetime_exact": "0.20",
    "datetime_close": "0.12", "bank_time_unavailable": "0.00", "merchant_semantic_match": "0.10", "match_phase_exact": "0.00", "match_phase_fuzzy": "0.00",
}
#: Statement formats: the headers that a file's header row holds.
FORMATS = {
    "alipay_official": ["交易时间", "交易分类", "交易对方", "商品说明", "收/支", "金额", "收/付款方式", "交易状态", "交易订单号"],
    "alipay_v3": ["交易时间", "交易分类", "交易对方", "商品说明", "金额", "收/支", "收付款方式", "交易状态"],
    "alipay_v2": ["交易订单号", "商户订单号", "创建时间", "对方账户", "金额", "收/付款方式", "交易状态"],
    "alipay_v1": ["交易号", "商家订单号", "交易创建时间", "交易对方", "商品名称", "金额（元）", "收/支", "交易状态"],
    "wechat": ["交易时间", "交易类型", "交易对方", "商品", "收/支", "金额(元)", "支付方式", "当前状态"],
    "cqrcb": ["交易日期", "交易发生额", "账户余额", "对方账号", "摘要"],
    "unionpay": ["交易日期", "交易类型", "交易金额"],
    "bank": ["日期|交易日期|记账日期|记账日|Date", "收入|贷方金额|收入金额|转入金额|Credit|交易金额|金额", "余额|账户余额|联机余额|Balance"],
}
HANDLED_STATUSES = {"alipay": ["交易成功", "退款成功", "已全额退款", "支付成功", "交易关闭", "退款中"]}
BLANK_MARKERS = ["（空）", "(空)", "空"]
#: What a product and a wallet are called, by the words of a bank row.
PRODUCT_MOVES = ["朝朝宝转入", "朝朝宝转出"]
# End of the fixed values.
