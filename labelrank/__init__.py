"""labelrank: retrieval-data preparation, search and evaluation as Spark DataFrame jobs.

Every public function takes and returns ``pyspark.sql.DataFrame`` objects (or column
expressions).  Models, tokenizers and text generators are plug-ins used from
``mapInPandas``; everything else is built-in Spark SQL expressions, joins, windows
and aggregates so Catalyst and whole-stage codegen do the physical work.
"""

__version__ = "0.1.0"

from labelrank.functions.prompts import (answer_messages, relevance_messages, render_chat,  # noqa: E402,F401
                                         utility_messages, utility_ranking_messages)
from labelrank.functions.replies import (apply_permutation, parse_ranking, parse_selection,  # noqa: E402,F401
                                         permute_records)
from labelrank.functions.text import (format_passage, format_query, has_hard_negatives,  # noqa: E402,F401
                                      relevance_filter, strip_reasoning, title_sep_join, truncate_words)
from labelrank.operators.knn import knn_exact, score_pairs  # noqa: E402,F401
from labelrank.operators.lookup import (attach_passages, attach_query, attach_teacher_scores,  # noqa: E402,F401
                                        offset_to_id)
from labelrank.operators.metrics import (check_duplicates, eval_acc, eval_msmarco, eval_mrr_at_k,  # noqa: E402,F401
                                         eval_trec, qrels_restrict, run_join_qrels)
from labelrank.operators.ranking import (assign_batches, global_index, position_within,  # noqa: E402,F401
                                         rank_by_score, topk_per_query, train_order)
from labelrank.operators.sampling import (fill, group_all_positives, group_first_positive,  # noqa: E402,F401
                                          group_from_records, group_pooled, group_rotate, group_rotate_pooled,
                                          random_negatives)
from labelrank.plans.jobs import (annotate_answer, annotate_relevance, annotate_utility,  # noqa: E402,F401
                                  build_training, evaluate, export_training_sets, rank_utility)
