"""Words from which a query's intent, time and domain are read; any of them can be replaced."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Signal words and weights of each intent.
INTENTS = {
    "news": {"公告": 0.9, "新闻": 0.9, "消息": 0.8, "异动": 0.85, "突发": 0.9, "速递": 0.85, "报道": 0.8, "刚刚": 0.9, "今天": 0.8, "今日": 0.8, "最新": 0.7, "收盘": 0.75, "快讯": 0.8},
    "analysis": {"分析": 0.9, "逻辑": 0.85, "研报": 0.9, "深度": 0.8, "报告": 0.7, "展望": 0.75, "评估": 0.8, "研究": 0.8, "估值": 0.8, "基本面": 0.8, "风险": 0.7},
    "strategy": {"复盘": 0.95, "策略": 0.85, "止损": 0.85, "仓位": 0.8, "教训": 0.9, "经验": 0.8, "操作": 0.7, "回撤": 0.75, "证伪": 0.85, "不及预期": 0.85},
    "concept": {"知识图谱": 0.85, "图谱": 0.8, "节点": 0.8, "实体关系": 0.8, "node": 0.75, "nodes": 0.75, "sector": 0.7},
    "market_data": {"行情": 0.9, "走势": 0.8, "K线": 0.85, "均线": 0.8, "盘面": 0.85, "成交量": 0.7, "换手率": 0.7, "股价": 0.7},
}
#: Signal words of domains, groups of time words with days.
DOMAINS = {
    "financial_report": {"财报": 1.0, "季报": 0.95, "年报": 0.95, "业绩": 0.85, "营收": 0.9, "利润": 0.85, "毛利率": 0.85, "现金流": 0.8},
    "macro": {"美联储": 0.95, "加息": 0.9, "降息": 0.9, "CPI": 0.85, "GDP": 0.9, "通胀": 0.85, "利率": 0.8, "汇率": 0.75},
    "market_event": {"涨停": 0.9, "跌停": 0.9, "大涨": 0.8, "大跌": 0.8, "回调": 0.7, "反弹": 0.7},
    "strategy_domain": {"复盘": 0.9, "止损": 0.85, "仓位": 0.8, "策略": 0.8},
    "supply_chain": {"产业链": 0.9, "上下游": 0.85, "供应商": 0.8, "供应链": 0.85},
    "knowledge_graph": {"知识图谱": 0.9, "图谱": 0.8, "节点": 0.8},
}
TIME_BIAS = [(["今天", "刚刚", "今日"], 3), (["昨日", "昨天"], 7), (["本周"], 14), (["最近", "最新", "近期", "近日"], 30), (["本月"], 60), (["财报", "季报", "年报", "半年报"], 90), (["今年", "本年度"], 180)]

#: Channel weights, and how intents, profiles and domains change them.
BASE = {"bm25": 1.2, "vector": 1.0, "name": 2.5, "structural": 0.2, "time": 0.25, "position": 0.12}
CHANNELS = list(BASE)
INTENT_FACTORS = {
    "entity_lookup": (0.6, 0.5, 2.0, 0.5, 0.3, 0.5), "news": (1.5, 0.8, 1.0, 0.6, 2.5, 1.8), "analysis": (1.0, 1.5, 0.8, 2.0, 0.6, 1.5), "strategy": (1.2, 1.2, 0.7, 1.0, 0.5, 1.2),
    "concept": (0.7, 1.8, 0.6, 1.5, 0.4, 0.6), "market_data": (1.4, 0.7, 0.8, 0.5, 2.0, 1.0), "general": (1.0,) * 6,
}
PROFILES = {
    "short": {"bm25": 1.2, "vector": 0.8, "name": 1.3, "position": 1.15}, "long": {"bm25": 0.9, "vector": 1.2}, "specific": {"name": 1.5, "bm25": 1.1},
    "ticker": {"name": 3.0, "bm25": 0.5, "vector": 0.3}, "time": {"time": 1.8},
}
DOMAIN_FACTORS = {
    "financial_report": {"bm25": 1.2, "vector": 0.9, "structural": 1.3, "position": 1.2}, "macro": {"bm25": 1.1, "vector": 1.1}, "market_event": {"bm25": 1.2, "time": 1.5},
    "strategy_domain": {"bm25": 1.1, "vector": 1.1, "position": 1.1}, "supply_chain": {"vector": 1.2}, "knowledge_graph": {"bm25": 1.5, "name": 2.0, "structural": 1.8, "position": 0.7},
}
#: Final weights (reranker, fused, entity, time, type) with and without reranker, and type priorities (record, node).
FINAL = {
    "entity_lookup": ((0.20, 0.25, 0.25, 0.05, 0.25), (0, 0.35, 0.30, 0.05, 0.30)), "news": ((0.25, 0.20, 0.08, 0.35, 0.12), (0, 0.30, 0.08, 0.45, 0.17)),
    "analysis": ((0.50, 0.20, 0.10, 0.10, 0.10), (0, 0.50, 0.20, 0.10, 0.20)), "strategy": ((0.35, 0.25, 0.08, 0.12, 0.20), (0, 0.33, 0.10, 0.15, 0.42)),
    "concept": ((0.75, 0.05, 0.05, 0.05, 0.10), (0, 0.45, 0.20, 0.10, 0.25)), "market_data": ((0.20, 0.20, 0.05, 0.40, 0.15), (0, 0.30, 0.05, 0.50, 0.15)),
    "general": ((0.40, 0.25, 0.12, 0.10, 0.13), (0, 0.40, 0.15, 0.12, 0.33)),
}
PRIORITY = {
    "entity_lookup": (1.0, 0.85), "news": (2.0, 0.3), "analysis": (0.75, 0.9), "strategy": (0.78, 0.6), "concept": (0.75, 1.0), "market_data": (2.0, 0.35), "general": (1.0, 0.7),
}


@dataclass(frozen=True)
class Lexicon:
    intents: dict[str, dict[str, float]] = field(default_factory=lambda: INTENTS)
    domains: dict[str, dict[str, float]] = field(default_factory=lambda: DOMAINS)
    time_bias: list[tuple[list[str], int]] = field(default_factory=lambda: TIME_BIAS)
    synonyms: dict[str, list[str]] = field(default_factory=dict)
    stopwords: tuple[str, ...] = ()
