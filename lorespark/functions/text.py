"""Text functions as Columns: normalising, tokenising, scrubbing, query analysis. All run inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, closing marks, word lists and patterns.
SPACE = "[\\s\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
TAIL = "。．.!！?？;；,，:："
NEGATIONS = ["不能", "不得", "不要", "不应", "不该", "不可", "不会", "不用", "禁止", "避免", "切勿", "勿", "非", "无", "没", "not ", "never", "no ", "don't", "doesn't", "cannot"]
SCRUB = [
    ("(?s)-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----.*?-----END [A-Z0-9 ]*PRIVATE KEY-----", "[redacted]"),
    ("(?i)(api[_-]?key|token|secret|password|authorization|passwd)\\s*[:=]\\s*\\S+", "[redacted]"),
    ("\\bsk-[A-Za-z0-9_\\-]{8,}\\b", "[redacted]"),
    ("\\bAKIA[0-9A-Z]{16}\\b", "[redacted]"),
    ("(?i)\\bbearer\\s+[A-Za-z0-9._\\-]{8,}", "[redacted]"),
    ("(?i)\\b([a-z][a-z0-9+.-]*://)([^/\\s:@]+:[^/\\s@]+)@", "$1[redacted]@"),
]
KINDS = [("pitfall", "踩坑|报错|失败|坑了|不要再|(?i)\\berror\\b"), ("decision", "决策|决定|定为|之所以|拍板"), ("preference", "偏好|默认|禁用|优先用|不要用"), ("task", "待办|还剩|下次|做到哪|(?i)\\bTODO\\b")]
STOP_IDENTIFIERS = "the and for with how what why this that you are was not use using can from into about please when where which to of in on is it thing things something anything stuff".split()
SOCIAL = (
    "你好 您好 hi hello hey 谢谢 多谢 thanks thank thx 好的 好 ok okay 嗯 嗯嗯 收到 了解 明白 明白了 继续 在吗 在么 早 早上好 晚安 辛苦 辛苦了 没事 随便 可以 行 行吧 再见 拜拜 "
    "你好呀 您好呀 嗨 哈喽 谢谢你 多谢啦 好滴 好嘞 收到啦 明白啦 继续吧 在不在 没问题 可以呀"
).split()
TECH_SHORT = (
    "报错 异常 超时 崩溃 卡死 修复 排查 调试 回滚 上线 发布 提交 合并 分支 冲突 接口 字段 索引 缓存 日志 依赖 版本 编译 构建 部署 配置 测试 脚本 路径 目录 权限 环境 数据 查询 检索 "
    "记忆 规则 偏好 决策 任务 问题 内存 线程 进程 网络 端口 证书 密钥 迁移 备份 恢复 同步 评审 文档 注释 函数 变量 类型 错误 性能"
).split()
DEEP = ["深查", "详细查", "查全", "查一下全部", "完整历史", "全部相关", "所有相关", "都查一下", "翻一下记忆", "把所有相关"]
TOKEN = "\\p{IsHan}+|[\\p{L}\\p{Nd}&&[^\\p{IsHan}]]+"
HAN = "[\\u4e00-\\u9fff]"


def _folding() -> tuple[str, str]:
    """Lower-case Latin letters that are an ASCII letter with marks, and those letters; behind them the combining marks, which have no counterpart and so are dropped."""
    latin = [(c, base) for i in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if (base := unicodedata.normalize("NFD", c := chr(i))[0]) != c and "a" <= base <= "z"]
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(c for c, _ in latin) + marks, "".join(b for _, b in latin)


FOLD_FROM, FOLD_TO = _folding()


def normalize(c: Column) -> Column:
    """Lower case, white space folded and trimmed, closing marks stripped."""
    folded = F.regexp_replace(F.lower(c), f"{SPACE}+", " ")
    return F.rtrim(F.trim(folded), F.lit(TAIL))


def content_hash(c: Column) -> Column:
    return F.sha2(normalize(c), 256)


def tokens(c: Column) -> Column:
    """Maximal Han runs and maximal letter/digit runs, lower-cased, accents folded."""
    return F.regexp_extract_all(F.translate(F.lower(c), FOLD_FROM, FOLD_TO), F.lit(TOKEN), F.lit(0))


def grams(run: Column, n: int) -> Column:
    size = F.length(run)
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), lambda i: F.substr(run, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def is_han(run: Column) -> Column:
    return run.rlike("^\\p{IsHan}")


def index_terms(c: Column) -> Column:
    """Index terms of a text: a Han run gives its single characters and then its pairs; a word gives itself. Texts without Han take the short way."""
    mixed = F.flatten(F.transform(tokens(c), lambda t: F.when(is_han(t), F.concat(grams(t, 1), grams(t, 2))).otherwise(F.array(t))))
    return F.when(c.rlike("\\p{IsHan}"), mixed).otherwise(tokens(c))


def _plain() -> dict[int, int]:
    """Code points of which the lower-cased ASCII letter or digit is known, 0 if they stand in no term, -1 if they are dropped: ASCII, Latin letters with marks, combining marks, common signs."""
    fold = {c: (FOLD_TO + "\0")[min(i, len(FOLD_TO))] for i, c in enumerate(FOLD_FROM)}
    out = {}
    for i in (*range(0x250), *range(0x300, 0x370), *range(0x1E00, 0x1F00), *range(0x2000, 0x2070), *range(0x20A0, 0x20C0), *range(0x2100, 0x2150), *range(0x2190, 0x2600)):
        c, kind = chr(i), unicodedata.category(chr(i))
        low = c.lower() if c != "\u0130" else ""
        if low in fold and len(low) == 1:
            out[i] = ord(fold[low]) or -1
        elif c.isascii() and c.isalnum():
            out[i] = ord(low)
        elif kind[0] not in "LM" and kind not in ("Nd", "Cn"):
            out[i] = 0
    return out


PLAIN = _plain()


def plain(c: Column) -> Column:
    """The text if all its characters are of PLAIN: its index terms are the runs of what they stand for. Null else."""
    runs = []
    for i in sorted(i for i in PLAIN if i > 0x7F):
        if runs and i == runs[-1][1] + 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    # characters of ASCII are told first: the long list of others is slow
    other = "[[^\\x00-\\x7F]&&[^" + "".join(f"\\u{x:04x}-\\u{y:04x}" for x, y in runs) + "]]"
    return F.when((F.octet_length(c) == F.length(c)) | ~c.rlike(other), c)


def query_phrases(c: Column) -> Column:
    """Phrases (grp, term, prefix) of a query: a Han run is a group of its pairs (one character: itself), a word a group of one prefix."""
    one = lambda t, i: F.transform(F.when(is_han(t), F.when(F.length(t) == 1, F.array(t)).otherwise(grams(t, 2))).otherwise(F.array(t)), lambda w: F.struct(i.alias("grp"), w.alias("term"), (~is_han(t)).alias("prefix")))
    return F.flatten(F.transform(tokens(c), one))


def scrub(c: Column) -> Column:
    for pattern, to in SCRUB:
        c = F.regexp_replace(c, pattern, to)
    return c


def digits(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)))


def negation_count(c: Column) -> Column:
    low = F.lower(c)
    return sum(((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w) for w in NEGATIONS), F.lit(0.0)).cast("int")


def rule_kind(c: Column) -> Column:
    out = F.lit("")
    for kind, pattern in reversed(KINDS):
        out = F.when(c.rlike(pattern), kind).otherwise(out)
    return out


def identifiers(c: Column) -> Column:
    """Technical identifiers of a query: ASCII runs of two or more with a letter, trimmed, without stop words, distinct."""
    runs = F.regexp_extract_all(c, F.lit("[A-Za-z0-9_.\\-/:]{2,}"), F.lit(0))
    cut = F.transform(runs, lambda t: F.regexp_replace(F.lower(t), "^[._\\-/:]+|[._\\-/:]+$", ""))
    return F.array_distinct(F.filter(cut, lambda t: (F.length(t) >= 2) & t.rlike("[a-z]") & ~t.isin(STOP_IDENTIFIERS)))


def query_terms(c: Column) -> Column:
    """Terms a text can cover: pairs of Han runs, identifier runs of two or more without stop words, distinct, in order."""
    runs = F.regexp_extract_all(c, F.lit(f"{HAN}+|[A-Za-z0-9_.\\-/:]+"), F.lit(0))
    cut = lambda t: F.regexp_replace(F.lower(t), "^[._\\-/:]+|[._\\-/:]+$", "")
    one = lambda t: F.when(t.rlike(f"^{HAN}"), grams(t, 2)).otherwise(F.filter(F.array(cut(t)), lambda w: (F.length(w) >= 2) & ~w.isin(STOP_IDENTIFIERS)))
    return F.array_distinct(F.flatten(F.transform(runs, one)))


def contains_ident(text: Column, ident: Column) -> Column:
    """Whether ident stands in text with no word character at either side."""
    quoted = F.concat(F.lit("(?<![A-Za-z0-9_])"), F.regexp_replace(ident, "([^A-Za-z0-9_])", "\\\\$1"), F.lit("(?![A-Za-z0-9_])"))
    return F.regexp_like(text, quoted)


def term_coverage(text: Column, terms: Column) -> Column:
    low = F.lower(text)
    return F.size(F.filter(terms, lambda t: F.when(t.rlike("[A-Za-z]"), contains_ident(low, t)).otherwise(F.contains(low, t))))


def query_gate(c: Column, explicit: Column | None = None) -> Column:
    """run, empty, pleasantry or short_no_tech; what is asked for explicitly passes."""
    if explicit is not None:
        return F.when(F.coalesce(explicit, F.lit(False)), "explicit").otherwise(query_gate(c))
    body = F.lower(F.regexp_replace(c, "[^A-Za-z0-9\\u4e00-\\u9fff]", ""))
    words = F.filter(F.split(F.lower(c), "[^a-z0-9\\u4e00-\\u9fff]+"), lambda t: t != "")
    social = (F.size(words) > 0) & F.forall(words, lambda t: t.isin(SOCIAL))
    short = (F.length(body) <= 1) | ((F.length(body) == 2) & ~body.rlike("[a-z0-9]") & ~body.isin(TECH_SHORT))
    return F.when(c.isNull() | (body == ""), "empty").when(social, "pleasantry").when(short, "short_no_tech").otherwise("run")


def wants_deep(c: Column) -> Column:
    return c.rlike("|".join(DEEP))


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(c, F.lit(SPACES))


def fields(c: Column) -> Column:
    """White space runs of any kind as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def one_line(c: Column, limit: int) -> Column:
    flat = F.trim(F.regexp_replace(c, f"{SPACE}+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("…"))).otherwise(flat)


def user_query_text(c: Column) -> Column:
    """The ``<user_query>`` blocks, one a line; without any the text less its ``<system-reminder>`` blocks."""
    blocks = F.transform(F.regexp_extract_all(c, F.lit("(?s)<user_query>(.*?)</user_query>"), F.lit(1)), lambda b: F.trim(b))
    return F.when(F.size(blocks) > 0, F.array_join(blocks, "\n")).otherwise(F.trim(F.regexp_replace(c, "(?s)<system-reminder>.*?</system-reminder>", "")))
