"""Host events as Column expressions: what a prompt asks for, what a tool does, what a command reads, and the checks on a final answer."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemolake.functions.columns import any_in, stripped, text_of

# Patterns and names of the classes.
DIRECT = r"(?i)直接(?:读|看|打开|检查)文件|运行命令|执行命令|read\s+the\s+file|open\s+the\s+file|run\s+(?:a\s+)?command|cat\s+|sed\s+|grep\s+"
MAINTENANCE = (
    r"(?i)修复|实现|重构|审计|审核|评审|检查代码|改代码|开发|调试|(?:测试)(?:代码|用例|失败|一下|这个)|(?:验证)(?:修复|结果是否|一下|这个)|生成|写入|写日报|更新日报|(?:更新)(?:代码|分支|上去|一下|这个|报告)|创建|修改|删除|安装|升级|"
    r"(?:提交)(?:代码|变更|这个分支|到|上去|PR)|推送|合并|rebase|重启|启动|停止|排查|诊断|交付|交了|整理|发布|部署|fix|implement|refactor|audit|review|(?:test)\s+(?:code|suite|failure)|verify\s+(?:the\s+)?(?:fix|result)|generate|write|"
    r"update\s+(?:code|branch|report)|create|modify|delete|install|upgrade|commit\s+(?:changes|this|the\s+branch)|push|merge|restart|start|stop|diagnose|deploy"
)
RUNS = r"(?i)(?:运行|执行)\s*(?:命令|测试|脚本|任务|用例|pytest|npm|一下)|(?:同步|拉取)\s*(?:仓库|分支|源|代码|文件|一下)|\b(?:run|sync)\s+(?:tests?|commands?|scripts?|repo(?:sitory)?|branch)"
FACTS = r"(?i)记忆|知识库|仓库|代码库|实验结果|评测结果|日报|周报|历史报告|研究结论|最近|最新|运行结果|最近在做|最近做了什么|上次|之前|进展|状态|根据记录|来源|证据|citation|repository|repo\b|experiment|evaluation|benchmark|latest|recent|history|report|according to"
FILE_READERS = ("read", "file_read", "read_file", "filesystem.readfile", "filesystem.read_file", "fs.readfile", "fs.read_file")
SHELLS = ("exec", "shell", "terminal", "bash", "zsh", "python", "python3", "code_mode_exec", "code.exec", "git")
FILE_READER_NAME = r"(?:^|[._:-])(?:filesystem|fs|file)(?:[._:-])(?:read|readfile|read_file)$"
SHELL_NAME = r"(?:^|[._:-])(?:exec|shell|terminal|bash|zsh)$"
READS = (r"(?i)(?:^|[;&|]\s*)(?:cat|sed|grep|rg|awk|head|tail|less|more|bat)\b", r"(?i)(?:^|[;&|]\s*)git\s+(?:show|log|grep)\b", r"(?i)\b(?:open|read_text|read_bytes|readFile|readFileSync)\s*\(")
DESTROYS = r"(?i)\b(?:rm|rmdir|mkfs|shutdown|reboot|kill\s+-9|git\s+(?:reset|clean|checkout\s+--|rebase|push))\b"
RECALL_LINES = (r"^\s*The following is conversation memory, not repository citation\.", r"^\s*-\s*\[[^\]\n]+\]\s.*\(memory_id=")
INPUT_NAMES = ("command", "cmd", "script", "code", "input", "path", "file", "args")
CHAINED = r"[;&|`$<>]"
SERVICE_WORDS, HOST_WORDS = "doctor|status|probe|health|restart|start|stop|reload|version|mcp", r"mcp\s+probe|doctor|plugins\s+inspect"
RECOVERS = (r"(?i)\blaunchctl\s+(?:print|list|kickstart)\b", r"(?i)\b(?:ps|lsof)\b")


def is_direct(prompt: Column | str) -> Column:
    return text_of(prompt).rlike(DIRECT)


def own_words(prompt: Column | str, tag: str) -> Column:
    """A prompt without recalled memory that was put before it in a <tag> block: whole blocks go, and of blocks that were cut off the tags,
    the sentence at their head and the bullets that name a memory."""
    whole = F.regexp_replace(text_of(prompt), rf"<{tag}>[\s\S]*?</{tag}>", " ")
    gone = (rf"^\s*</?{tag}>\s*$", *RECALL_LINES)
    kept = F.filter(F.split(whole, "\n", -1), lambda line: ~reduce(Column.__or__, (line.rlike(p) for p in gone)))
    return stripped(F.array_join(kept, "\n"))


def prompt_policy(prompt: Column | str, tag: str | None = None) -> Column:
    """maintenance, repository-fact or ordinary, of what a user says; tag: that of the blocks in which recall is put before a prompt.
    A prompt that asks for work is no question of fact."""
    p = stripped(prompt) if tag is None else own_words(prompt, tag)
    works = (p != "") & (p.rlike(DIRECT) | p.rlike(MAINTENANCE) | p.rlike(RUNS))
    return F.when(works, "maintenance").when((p != "") & p.rlike(FACTS), "repository-fact").otherwise("ordinary")


def tool_input(tool: Column | str, params: Column) -> Column:
    """What a tool call runs or reads: the first of a map's usual entries that is not empty; arguments of git begin with its name."""
    first = F.coalesce(*(F.nullif(F.try_element_at(params, F.lit(k)), F.lit("")) for k in INPUT_NAMES), F.lit(""))
    git = (F.lower(text_of(tool)) == "git") & (F.coalesce(F.try_element_at(params, F.lit("args")), F.lit("")) != "")
    return stripped(F.when(git, F.concat(F.lit("git "), first)).otherwise(first))


def safe_recovery(command: Column | str, services: tuple[str, ...] = (), hosts: tuple[str, ...] = ()) -> Column:
    """Whether a command only looks after a service: no chaining or substitution, nothing that destroys, and an operation on one of `services` (names of
    memory services) or `hosts` (names of their host's command line), of the service manager, or a look at processes."""
    c = text_of(command)
    names = lambda words: "|".join(re.escape(w) for w in words)
    ways = [c.rlike(RECOVERS[0]), c.rlike(RECOVERS[1])]
    ways += [c.rlike(rf"(?i)\b(?:{names(services)})\b[\s\S]*\b(?:{SERVICE_WORDS})\b")] if services else []
    ways += [c.rlike(rf"(?i)\b(?:{names(hosts)})\s+(?:{HOST_WORDS})\b")] if hosts else []
    return (c != "") & ~c.rlike(CHAINED) & ~destroys(c) & reduce(Column.__or__, ways)


def tool_kind(tool: Column | str) -> Column:
    """file-read, shell, or null for any other tool."""
    name = F.lower(stripped(tool))
    return F.when(name.isin(*FILE_READERS) | name.rlike(FILE_READER_NAME), "file-read").when(name.isin(*SHELLS) | name.rlike(SHELL_NAME), "shell")


def reads_evidence(command: Column | str) -> Column:
    c = text_of(command)
    return c.rlike(READS[0]) | c.rlike(READS[1]) | c.rlike(READS[2])


def destroys(command: Column | str) -> Column:
    return text_of(command).rlike(DESTROYS)


def has_receipt(answer: Column, keys: Column) -> Column:
    """Whether an answer names some commit or path of the evidence."""
    return any_in(text_of(answer), keys)


def finalize_warning(answer: Column, abstains: Column, receipt: Column, searched: Column, verified: Column, answerable: Column, repository_answerable: Column, recalled: Column, search_abstained: Column) -> Column:
    """The first check that a final answer fails, null if none: a receipt that is missing, a retrieval that was skipped, claims that the citations
    do not carry, an answer out of an empty retrieval."""
    said = text_of(answer) != ""
    return (
        F.when(said & (repository_answerable > 0) & ~receipt, "missing_receipt").when(said & (recalled > 0) & ~searched & ~abstains, "missing_retrieval")
        .when(said & (verified > 0) & (answerable == 0) & ~abstains, "unsupported_claim").when(said & searched & (verified == 0) & ~search_abstained & ~abstains, "empty_retrieval")
    )


def expected_tool(tool: Column, suffix: str, *prefixes: str) -> Column:
    """Whether a tool's name is one of those under which an operation is offered."""
    return tool.isin(f"repository_{suffix}", *(f"{p}{suffix}" for p in prefixes))
