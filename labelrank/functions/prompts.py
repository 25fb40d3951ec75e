"""Chat prompts as ``array<struct<role,content>>`` columns.

The texts below are fixed values that must equal the reference prompts
character for character (they are what the annotating model sees).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelrank.functions.text import truncate_words

# ---- fixed values: prompt texts ------------------------------------------------
RELEVANCE_SYSTEM = ("You are the relevance judger, an intelligent assistant that can select the passages "
                    "that are relevant to the question.")
RELEVANCE_ACK = "Yes, I am the relevance judger."
RELEVANCE_TASK = ("I will provide you with {num} passages, each indicated by number identifier []. "
                  "\nSelect the passages that are relevant to the question: {query}.")
RELEVANCE_READY = "Okay, please provide the passages."
RELEVANCE_POST = "Search Query: {query}.{instruct}"

UTILITY_SYSTEM = ("You are the utility judger, an intelligent assistant that can select the passages that "
                  "have utility in answering the question.")
UTILITY_ACK = "Yes, I am the utility judger."
UTILITY_TASK = ("I will provide you with {num} passages, each indicated by number identifier []. \n "
                "I will also provide you with a reference answer to the question. \nSelect the passages "
                "that have utility in generating the reference answer to the following question from the "
                "{num} passages: {query}.")
UTILITY_READY = "Okay, please provide the passages and the reference answer."
UTILITY_POST = ("Question: {query}. \n Reference answer: {answer}. \n\n The requirements for judging whether "
                "a passage has utility in answering the question are: The passage has utility in answering "
                "the question, meaning that the passage not only be relevant to the question, but also be "
                "useful in generating a correct, reasonable and perfect answer to the question. \n{instruct}")

RANKING_SYSTEM = ("You are RankGPT, an intelligent assistant that can rank passages based on their utility "
                  "in generating the given reference answer to the question.")
RANKING_ACK = "Yes, i am RankGPT."
RANKING_TASK = ("I will provide you with {num} passages, each indicated by number identifier [].  I will "
                "also give you a reference answer to the question. \nRank the passages based on their "
                "utility in generating the reference answer to the question: {query}.")
RANKING_READY = "Okay, please provide the passages and the reference answer."
RANKING_POST = ("Question: {query}. \n\n Reference answer: {answer}\n\n Rank the {num} passages above based "
                "on their utility in generating the reference answer to the question. The passages should "
                "be listed in utility descending order using identifiers.  The passages that have utility "
                "generating the reference answer to the question should be listed first. The output format "
                "should be [] > [] > [] > ..., e.g., [i] > [j] > [k] > ... Only response the ranking "
                "results, do not say any word or explain.")

ANSWER_SYSTEM = ("You are a faithful question and answer assistant. Answer the question based on the given "
                 "information with one or a few sentences without the source.")
ANSWER_ACK = "Yes, i am the faithful question and answer assistant."
ANSWER_TASK = ("Given the information: \n{passages}\n Answer the following question based on the given "
               "information with one or a few sentences without the source.\n Question: {query}\n\n Answer:")

RELEVANCE_INSTRUCT = ("\n        Directly output the passages you selected that are relevant to the question. "
                      "The format of the output is: 'My selection:[[i],[j],...].'. Only response the "
                      "selection results, do not say any word or explain. \n        ")
UTILITY_INSTRUCT = ("\n        Directly output the passages you selected that have utility in generating the "
                    "reference answer to the question. The format of the output is: 'My selection:[[i],[j],"
                    "...].'. Only response the selection results, do not say any word or explain. \n        ")
PASSAGE_TURN = "[{rank}] {passage}"
PASSAGE_ACK = "Received passage [{rank}]."

# ChatML-style default template (model templates are plug-ins)
CHAT_TURN = "<|im_start|>{role}\n{content}<|im_end|>\n"
CHAT_GENERATION = "<|im_start|>assistant\n"
# ---- end of fixed values -------------------------------------------------------

MAX_WORDS = 300


def fill(template: str, **cols) -> Column:
    """Format a ``{name}`` template with column values (a ``concat`` of literals and columns)."""
    import re
    parts, pos = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        v = cols[m.group(1)]
        parts.append(v.cast("string") if isinstance(v, Column) else F.lit(str(v)))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def msg(role: str, content) -> Column:
    c = content if isinstance(content, Column) else F.lit(content)
    return F.struct(F.lit(role).alias("role"), c.alias("content"))


def passage_turns(passages: Column, max_words: int | None = MAX_WORDS) -> Column:
    """Two turns per passage: ``[rank] text`` (text cut to ``max_words``) and the acknowledgement."""
    def turns(p, i):
        text = truncate_words(p, max_words) if max_words else p
        rank = i + 1
        return F.array(msg("user", fill(PASSAGE_TURN, rank=rank, passage=text)),
                       msg("assistant", fill(PASSAGE_ACK, rank=rank)))
    return F.flatten(F.transform(passages, turns))


def _with_passages(pre: list, passages: Column, post: Column, max_words) -> Column:
    return F.concat(F.array(*pre), passage_turns(passages, max_words), F.array(post))


def relevance_messages(query: Column, passages: Column, instruct: str = RELEVANCE_INSTRUCT,
                       max_words: int | None = MAX_WORDS) -> Column:
    num = F.size(passages)
    pre = [msg("user", RELEVANCE_SYSTEM), msg("assistant", RELEVANCE_ACK),
           msg("user", fill(RELEVANCE_TASK, num=num, query=query)), msg("assistant", RELEVANCE_READY)]
    return _with_passages(pre, passages, msg("user", fill(RELEVANCE_POST, query=query, instruct=instruct)),
                          max_words)


def utility_messages(query: Column, passages: Column, answer: Column, instruct: str = UTILITY_INSTRUCT,
                     max_words: int | None = MAX_WORDS) -> Column:
    num = F.size(passages)
    pre = [msg("user", UTILITY_SYSTEM), msg("assistant", UTILITY_ACK),
           msg("user", fill(UTILITY_TASK, num=num, query=query)), msg("assistant", UTILITY_READY)]
    post = msg("user", fill(UTILITY_POST, query=query, answer=answer, instruct=instruct))
    return _with_passages(pre, passages, post, max_words)


def utility_ranking_messages(query: Column, passages: Column, answer: Column,
                             max_words: int | None = MAX_WORDS) -> Column:
    num = F.size(passages)
    pre = [msg("user", RANKING_SYSTEM), msg("assistant", RANKING_ACK),
           msg("user", fill(RANKING_TASK, num=num, query=query)), msg("assistant", RANKING_READY)]
    post = msg("user", fill(RANKING_POST, query=query, answer=answer, num=num))
    return _with_passages(pre, passages, post, max_words)


def answer_messages(query: Column, passages: Column) -> Column:
    """Passages joined with newlines (not truncated), three turns."""
    task = fill(ANSWER_TASK, passages=F.array_join(passages, "\n"), query=query)
    return F.array(msg("user", ANSWER_SYSTEM), msg("assistant", ANSWER_ACK), msg("user", task))


def render_chat(messages: Column, turn: str = CHAT_TURN, generation: str = CHAT_GENERATION) -> Column:
    """Messages -> one prompt string with a generation header (template strings are parameters)."""
    body = F.array_join(F.transform(messages, lambda m: fill(turn, role=m["role"], content=m["content"])), "")
    return F.concat(body, F.lit(generation))
