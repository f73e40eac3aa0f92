"""Offline doc provider (I10): accessor patterns first, then a keyword cascade; en / zh."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from legible.functions import text as T

# ---- fixed values that must equal the reference's behaviour ---------------------------------
_MODS = "^\\s*(?:@\\w+(?:\\([^)]*\\))?\\s+)*(?:public|protected|private)?\\s*(?:static\\s+)?"
GETTER = _MODS + "[\\w$<>\\[\\].]+\\s+get([A-Z][\\w]*)\\s*\\("
SETTER = _MODS + "void\\s+set([A-Z][\\w]*)\\s*\\("
ISSER = _MODS + "(?:boolean|Boolean)\\s+is([A-Z][\\w]*)\\s*\\("

ACCESSOR_TEXT = {
    "en": {"get": "Gets %s.", "set": "Sets %s.", "is": "Returns whether %s."},
    "zh": {"get": "获取%s。", "set": "设置%s。", "is": "返回%s状态。"},
}
# (keywords tested with contains() on the lower-cased header, English text, Chinese text), in order
KEYWORD_RULES = [
    (["tojson", "fromjson", "json"], "Serializes/deserializes between JSON and objects.",
     "在 JSON 与对象之间进行序列化/反序列化。"),
    (["hash", "digest", "crc", "fnv"], "Computes and returns a hash/checksum.", "计算并返回哈希/校验值。"),
    (["parse", "tokenize"], "Parses the input and returns a structured result.", "解析输入并返回结构化结果。"),
    (["http", "request", "fetch"], "Performs a network request and processes the response.", "执行网络请求并处理响应。"),
    (["init", "setup", "configure"], "Performs necessary initialization/configuration.", "完成必要的初始化/配置。"),
    (["close", "shutdown", "dispose"], "Releases resources and shuts down safely.", "释放资源并安全关闭。"),
]
DEFAULT_TEXT = ("Performs the core function implied by its name.", "执行与方法名一致的核心功能。")
DETAILED_SUFFIX = (" (auto-generated by heuristics).", "（由启发式规则自动生成）")
# ----------------------------------------------------------------------------------------------


def _by_lang(lang: Column, en: str, zh: str) -> Column:
    return F.when(lang == "zh", F.lit(zh)).otherwise(F.lit(en))


def heuristic_doc(snippet, lang, style) -> Column:
    """One-sentence doc for a snippet whose first line is its header."""
    lang_c = F.lit(lang) if isinstance(lang, str) and lang in ("en", "zh") else T._c(lang)
    style_c = F.lit(style) if isinstance(style, str) and style in ("concise", "detailed") else T._c(style)
    header = T.java_trim(T.first_line(F.coalesce(T._c(snippet), F.lit(""))))
    lower = F.lower(header)
    out = None
    for kind, pat in (("get", GETTER), ("set", SETTER), ("is", ISSER)):
        hit = F.regexp_extract(header, pat, 1)
        text = F.replace(_by_lang(lang_c, ACCESSOR_TEXT["en"][kind], ACCESSOR_TEXT["zh"][kind]),
                         F.lit("%s"), T.split_camel(hit))
        cond = header.rlike(pat)
        out = F.when(cond, text) if out is None else out.when(cond, text)
    kw = None
    for words, en, zh in KEYWORD_RULES:
        cond = None
        for w in words:
            c = lower.contains(w)
            cond = c if cond is None else (cond | c)
        kw = F.when(cond, _by_lang(lang_c, en, zh)) if kw is None else kw.when(cond, _by_lang(lang_c, en, zh))
    kw = kw.otherwise(_by_lang(lang_c, *DEFAULT_TEXT))
    kw = F.when(style_c == "detailed", F.concat(kw, _by_lang(lang_c, *DETAILED_SUFFIX))).otherwise(kw)
    return out.otherwise(kw)
