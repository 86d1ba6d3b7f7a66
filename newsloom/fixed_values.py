"""Word lists, lookup tables and thresholds that decide results.

They are plain data, kept in natural order; every operator takes them as
parameters with these as defaults, so a deployment can pass its own tables.
"""

# --- fixed values: finance lexicon (term, weight) ---------------------------
FINANCE_POSITIVE = [
    ("业绩预增", 0.7), ("订单增长", 0.5), ("技术突破", 0.5), ("政策利好", 0.6),
    ("营收增长", 0.6), ("净利增长", 0.7), ("毛利率提升", 0.5), ("现金流改善", 0.5),
    ("ROE提升", 0.5), ("资产负债率下降", 0.4), ("产能释放", 0.4),
    ("买入评级", 0.6), ("超出预期", 0.8), ("超预期", 0.8),
    ("回购", 0.7), ("增持", 0.8), ("分红", 0.6), ("涨停", 0.7),
    ("突破", 0.4), ("新高", 0.6), ("扭亏", 0.7), ("中标", 0.5), ("获批", 0.5),
    ("补贴", 0.4), ("减免", 0.4), ("扩张", 0.3), ("并购", 0.3), ("上市", 0.3),
    ("加仓", 0.5), ("看多", 0.6),
    ("放水", 0.3), ("降息", 0.4), ("降准", 0.5), ("宽松", 0.3),
]
FINANCE_NEGATIVE = [
    ("资产负债率上升", -0.4), ("不及预期", -0.7), ("重组失败", -0.7), ("立案调查", -0.8),
    ("卖出评级", -0.6), ("业绩预亏", -0.7), ("营收下滑", -0.6), ("净利下滑", -0.6),
    ("毛利率下降", -0.5), ("现金流恶化", -0.6), ("ROE下降", -0.4),
    ("商誉减值", -0.7), ("订单下滑", -0.5), ("产能过剩", -0.5),
    ("减持", -0.7), ("套现", -0.7), ("爆雷", -0.9), ("跌停", -0.7), ("退市", -0.9),
    ("亏损", -0.6), ("下滑", -0.5), ("腰斩", -0.8), ("崩盘", -0.9), ("踩雷", -0.7),
    ("违约", -0.8), ("破产", -0.9),
    ("处罚", -0.6), ("罚款", -0.5), ("诉讼", -0.5), ("冻结", -0.6), ("查封", -0.7),
    ("做空", -0.5), ("看空", -0.5),
    ("裁员", -0.6), ("关停", -0.6),
    ("加息", -0.4), ("收紧", -0.4), ("通胀", -0.3), ("衰退", -0.6), ("危机", -0.5),
    ("贸易战", -0.6), ("制裁", -0.5), ("脱钩", -0.4),
]
FINANCE_MODIFIERS = {
    "大幅": 1.5, "显著": 1.3, "明显": 1.2, "略微": 0.5, "小幅": 0.5,
    "持续": 1.2, "连续": 1.1, "首次": 1.1, "再次": 1.0,
}
FINANCE_NEGATIONS = ["并非", "不算", "算不上", "谈不上", "未必", "不算是", "没有", "不是", "绝非"]

# --- fixed values: base sentiment dictionary --------------------------------
BASE_POSITIVE = [
    "利好", "增长", "上升", "改善", "向好", "上涨", "盈利", "强劲", "繁荣", "发展",
    "突破", "积极", "乐观", "强势", "提振", "推动", "促进", "刺激", "提升", "增强",
    "扩张", "复苏", "回暖", "超预期", "创新高",
]
BASE_NEGATIVE = [
    "下跌", "下降", "亏损", "衰退", "危机", "恶化", "疲软", "萎缩", "下滑", "负面",
    "利空", "忧虑", "悲观", "风险", "暴跌", "裁员", "违约", "爆雷",
]
BASE_DEGREES = {
    "非常": 2.0, "特别": 2.0, "极其": 3.0, "超级": 3.0, "十分": 2.0, "很": 1.5,
    "比较": 1.2, "稍微": 0.8, "有点": 1.1, "略微": 1.1, "大幅": 1.8, "大幅下跌": 1.8,
}
BASE_NEGATIONS = ["不", "无", "非", "未", "否", "别", "莫", "勿", "休"]

# --- fixed values: words reported with a score ------------------------------
REPORT_POSITIVE = [
    "利好", "增长", "上升", "改善", "盈利", "上涨", "突破", "积极", "乐观", "提振",
    "推动", "促进", "复苏", "回暖", "强势", "扩张", "强劲", "繁荣", "发展", "提升",
    "增强", "利好消息", "利好政策", "超预期", "创新高", "新高", "反弹", "企稳",
    "翻红", "领涨",
]
REPORT_NEGATIVE = [
    "下跌", "下降", "衰退", "恶化", "疲软", "萎缩", "下滑", "负面", "利空", "忧虑",
    "悲观", "危机", "风险", "暴跌", "亏损", "裁员", "违约", "爆雷", "退市",
    "不及预期", "大幅下跌", "利空消息", "跳水", "跌停",
]

# --- fixed values: stop words ------------------------------------------------
KEYWORD_STOP_WORDS = [
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都",
    "一", "一个", "上", "也", "很", "到", "说", "要", "去", "你", "会",
    "着", "没有", "看", "好", "自己", "这", "那", "他", "她", "它", "们",
    "与", "为", "但", "而", "及", "被", "把", "从", "对", "以", "将",
    "向", "或", "其", "可", "所", "如", "等", "还", "更", "能", "已",
]
TOPIC_STOP_WORDS = [
    "的", "了", "在", "是", "和", "就", "不", "也", "很", "到", "说",
    "要", "去", "你", "会", "着", "没有", "看", "好", "自己", "这", "那",
]
CLUSTER_STOP_WORDS = TOPIC_STOP_WORDS + ["与", "为", "但", "而", "及", "被", "把", "从", "对", "以", "将"]

# --- fixed values: named entities --------------------------------------------
COMPANIES = [
    "阿里巴巴", "腾讯", "华为", "京东", "美团", "比亚迪", "宁德时代",
    "贵州茅台", "工商银行", "建设银行", "农业银行", "中国银行", "招商银行",
    "中国平安", "中国人寿", "中信证券", "海通证券", "华泰证券",
    "万科", "碧桂园", "恒大", "融创", "保利",
    "格力", "美的", "海尔", "小米", "OPPO", "vivo", "大疆",
    "中芯国际", "寒武纪", "海光信息", "龙芯中科", "华为海思",
    "药明康德", "恒瑞医药", "迈瑞医疗", "百济神州",
    "隆基绿能", "通威股份", "阳光电源", "天合光能",
    "宁德", "蔚来", "理想", "小鹏", "特斯拉",
]
ORGANIZATIONS = [
    "央行", "证监会", "银保监会", "财政部", "发改委", "统计局",
    "美联储", "欧央行", "日央行", "IMF", "世界银行",
]
INDICATORS = [
    "沪深300", "上证指数", "深证成指", "创业板指", "科创50",
    "GDP", "CPI", "PPI", "PMI", "LPR", "MLF", "OMO",
]
COMPANY_MARKS = ["公司", "集团", "银行", "基金", "证券", "保险", "科技"]
ORGANIZATION_MARKS = ["央行", "部", "委", "局", "会"]

# --- fixed values: categories, first match wins ------------------------------
CATEGORY_KEYWORDS = {
    "宏观经济": ["宏观", "经济", "GDP", "CPI", "PPI", "央行", "统计局", "财政", "货币", "降息", "加息", "通胀", "通缩"],
    "股市动态": ["A股", "沪指", "深成指", "创业板", "沪深", "大盘", "涨停", "跌停", "板块", "牛市", "熊市", "指数"],
    "债券市场": ["债券", "国债", "信用债", "城投债", "企业债", "违约", "评级"],
    "外汇交易": ["汇率", "美元", "欧元", "日元", "人民币", "外汇", "美联储", "Fed"],
    "期货市场": ["期货", "原油", "黄金", "铜", "铁矿石", "大豆", "农产品"],
    "公司财报": ["财报", "业绩", "利润", "营收", "净利润", "年报", "季报", "公告", "披露"],
    "政策法规": ["政策", "法规", "监管", "证监会", "国务院", "改革", "意见", "通知"],
    "行业分析": ["行业", "赛道", "产业链", "新能源", "半导体", "医药", "消费", "科技"],
    "国际市场": ["美股", "港股", "纳指", "标普", "日经", "欧洲", "全球", "海外", "国际"],
    "投资策略": ["策略", "研报", "机构", "基金", "配置", "布局", "加仓", "减持", "估值"],
}
DEFAULT_CATEGORY = "综合财经"

# --- fixed values: sources ---------------------------------------------------
# (key, display name, tier)
SOURCES = [
    ("jinshi", "金十数据", "fast"),
    ("wallstreetcn", "华尔街见闻", "fast"),
    ("ths_api", "同花顺API", "fast"),
    ("cls_api", "财联社API", "fast"),
    ("xueqiu", "雪球", "fast"),
    ("eastmoney_api", "东方财富公告", "fast"),
    ("rss_xinhua", "RSS(新华网)", "fast"),
    ("rss_caixin", "RSS(财新)", "fast"),
    ("rss_ce", "RSS(经济日报)", "fast"),
    ("rss_huxiu", "RSS(虎嗅)", "fast"),
    ("rss_sspai", "RSS(少数派)", "fast"),
    ("rss_guancha", "RSS(观察者网)", "fast"),
    ("36kr", "36氪", "fast"),
    ("akshare", "AKShare(东财)", "fast"),
    ("eastmoney_web", "东方财富网页", "slow"),
    ("sina_finance", "新浪财经", "slow"),
    ("wechat_sogou", "微信公众号", "slow"),
    ("tmtpost", "钛媒体", "slow"),
    ("caixin", "财新网", "slow"),
    ("jiemian", "界面新闻", "slow"),
    ("netease_finance", "网易财经", "slow"),
    ("yicai", "第一财经", "slow"),
    ("10jqka", "同花顺", "slow"),
    ("baidu_finance", "百度财经API", "slow"),
]
# --- fixed values: names that articles of feeds and list pages carry
RSS_NAMES = {"rss_xinhua": "中新网财经", "rss_caixin": "财新RSS", "rss_ce": "华尔街见闻RSS", "rss_huxiu": "虎嗅", "rss_sspai": "少数派",
             "rss_guancha": "观察者网"}
WEB_NAMES = {"eastmoney_web": "东方财富", "sina_finance": "新浪财经", "netease_finance": "网易财经", "yicai": "第一财经", "10jqka": "同花顺",
             "baidu_finance": "百度财经", "tmtpost": "钛媒体", "caixin": "财新网", "jiemian": "界面新闻"}
MEDIA_SOURCES = ["微信公众号", "雪球", "虎嗅", "少数派", "36氪", "钛媒体", "观察者网"]
EXCLUDED_SOURCES = MEDIA_SOURCES + ["知乎"]
QUALITY_SOURCES = ["金十数据", "华尔街见闻", "财联社", "第一财经", "东方财富"]
HIGH_TRUST_SOURCES = ["金十数据", "财联社", "财联社RSS", "东方财富", "东方财富公告", "华尔街见闻"]
MEDIUM_TRUST_SOURCES = ["新浪财经", "第一财经", "网易财经", "同花顺", "同花顺API", "百度财经", "36氪", "虎嗅", "钛媒体"]

# --- fixed values: list page link rules, SQL predicates over (href, text) ----
LINK_RULES = {
    "eastmoney_web": "href like '%/a/%'",
    "sina_finance": "href like '%finance.sina.com%' or href like '%sina.com.cn/roll%'",
    "netease_finance": "(href like '%money.163.com%' and href not like '%http%') or href like '%/article/%'",
    "yicai": "href like '%yicai.com%' and (href like '%news%' or href like '%story%')",
    "10jqka": "href like '%10jqka.com.cn%'",
    "baidu_finance": r"href rlike 'baidu\\.com/(article|news|detail|\\d+)' or href rlike '^/\\d+'",
    "tmtpost": r"href rlike 'tmtpost\\.com/\\d+\\.html|^/(video|nictation)/\\d+\\.html'",
    "caixin": "href like '%caixin.com%' and (href like '%/detail/%' or href like '%article%' or href like '%news%')",
    "jiemian": "href like '%jiemian.com/article%' or href like '%jiemian.com/news%'",
}

# --- fixed values: entity graph ----------------------------------------------
ENTITY_FUNCTION_CHARS = ["是", "的", "了", "在", "和", "与", "被", "为"]
ENTITY_SUFFIXES = ["公司", "有限公司", "股份有限公司", "集团", "科技"]
FALLBACK_RELATION = "提及关系"
FALLBACK_DESCRIPTION = "在新闻中被同时提及"

# --- fixed values: events, limits, metrics -----------------------------------
EVENT_TYPES = ["article_click", "article_view", "search_click", "search_query"]
LATENCY_BUCKETS_MS = [5, 10, 25, 50, 100, 250, 500, 1000, 2000, 5000]
SUPPORTED_LANGUAGES = {"zh": "中文", "en": "英文", "ja": "日文", "ko": "韩文", "fr": "法文", "de": "德文"}
TRANSLATE_MARK = "[Translate required] "
