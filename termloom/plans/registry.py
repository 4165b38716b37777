"""Registry of the retrieval queries and their SQL twins."""

from __future__ import annotations

from termloom.plans import oracles
from termloom.plans import queries as Q

NAMES = (
    "tokens_alphanum tokens_symbol stopword_filter click_tokenizer analyze_symbol_stemmed analyze_english porter_terms postings doc_stats "
    "term_stats collection_stats tf_percentiles rebuilt_text analyzed_corpus_rows malformed_row_filter bm25_topk topics qrels corpus_semi_join "
    "missing_docs_anti test_split train_split test_qrels doc_query_lists first_queries busiest_documents per_query_metrics evaluation_summary "
    "click_edges two_core adjacency page_rank cg_weights cg_weights_uniform coclick_sim coclick_topk cg_expand collection_model unigram_model "
    "feedback_docs rlm_per_query weight_range scale_weights sorted_weights reweight_cg_multi reweight_rlm_multi reweight_combined_multi "
    "reweighted_bm25 variant_summary wilcoxon_w_z significance sorted_text_weights unplaced_weights latest_weights rewritten_documents "
    "read_raw_clicks read_clicked_ids read_raw_corpus read_corpus_lines counted_clicks clicks_after_line read_analyzed_corpus read_judgements "
    "read_quoted_judgements read_train_ids read_click_graph read_split_ids read_json_corpus stored_documents read_runs read_click_weights "
    "read_model_weights read_sorted_weights read_results read_index queries_per_document preprocess_clicks preprocess_corpus"
).split()


def queries() -> dict:
    found = {name: getattr(Q, name) for name in NAMES}
    found |= {f"rlm_{s}": Q.rlm_aggregated(s) for s in ("weighted_mean", "mean", "max")}
    found |= {f"reweight_{m}": Q.reweight_debug(m) for m in ("constant", "random", "weighted_random")}
    return found


def oracle_sql() -> dict[str, str]:
    return oracles.all_sql()
