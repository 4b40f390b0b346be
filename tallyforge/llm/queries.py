"""The registered queries of this package and their SQL."""

from __future__ import annotations

from .common import scratch, table


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_token_files(spark, sf_dir):
    from .token_files import read_token_files, write_token_files

    out = scratch(spark, "tokens")
    return read_token_files(spark, out, write_token_files(table(spark, sf_dir, "documents"), out, tokenizer()))


def op7_packing(spark, sf_dir):
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer())


def op4_quality_rules(spark, sf_dir):
    from .quality_rules import BASE, judge, train

    docs = table(spark, sf_dir, "documents")
    got = judge(docs, train(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", *BASE, "base_failed", "kept", "score")


def op5_line_quality(spark, sf_dir):
    from .line_quality import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def op3_language(spark, sf_dir):
    from .language import identify, train

    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))


def op2_secrets(spark, sf_dir):
    from .secrets import scan, train

    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(docs))


def op9_near_dup(spark, sf_dir):
    from .near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op6_decontaminate(spark, sf_dir):
    from .decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op1_suffix_dedup(spark, sf_dir):
    from .suffix_dedup import repeated_spans

    return repeated_spans(table(spark, sf_dir, "documents")).drop("spans")


def op8_tool_calls(spark, sf_dir):
    from .tool_calls import SCHEMAS, derived_calls, link

    calls, results, messages = derived_calls(table(spark, sf_dir, "conversations"))
    return link(calls, results, SCHEMAS, messages)


def op11_vector_codes(spark, sf_dir):
    from .vector_codes import compress

    return compress(table(spark, sf_dir, "embeddings"))


def op12_licenses(spark, sf_dir):
    from .licenses import scan

    return scan(table(spark, sf_dir, "documents")).drop("blocks")


def op13_chat_repair(spark, sf_dir):
    from .chat_repair import damage_and_repair

    return damage_and_repair(table(spark, sf_dir, "conversations"))


def queries():
    return {k: v for k, v in globals().items() if k.startswith("op")}


def oracle_sql():
    from . import chat_repair, licenses, tool_calls, vector_codes

    return {"op8_tool_calls": tool_calls.ORACLE, "op11_vector_codes": vector_codes.ORACLE, "op12_licenses": licenses.ORACLE, "op13_chat_repair": chat_repair.ORACLE}
