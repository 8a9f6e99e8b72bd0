"""Explicit schemas of logs, tasks and manifests, as DDL; nothing is inferred on read."""

TAGGED = "struct<data: string, metadata: string>"
PREDICTION_LOG = "task_id string, prompt string, model_output string, expected_output string, failure_type string, geometric double"
CODE_LOG = "task_id string, prompt string, model_output string, check_function string, canonical_solution string, failure_type string"
MCQ_LOG = "task_id string, prompt string, reasoning string, model_output string, correct_answer string, failure_type string, geometric double"
TEMPLATE_LOG = "task_id string, prompt string, reasoning string, model_output string, check_function string, canonical_solution string, func_input string, func_output string, failure_type string"
CODE_TASK = "_id string, qn string, qn_desc string, canon_solution string, examples map<string,string>, examples_text string, check string, original_id string, func_name string"
IO_TASK = "_id string, full_sol string, qn_desc string, input struct<args: string, metadata: array<string>>, output struct<args: string, metadata: string>, examples map<string,string>, original_id string, func_name string"
MCQ_TASK = "_id string, question string, qn_desc string, choices map<string,string>, check string, answer string, examples map<string,string>, func_name string, original_id string, corresponding_humaneval_id string"
TEMPLATE = f"_id string, question_template string, prompt_template string, solution_template string, func_name string, params array<struct<ord: int, params: {TAGGED}, func_input: {TAGGED}, func_output: {TAGGED}>>, original_id string"
MANIFEST = (
    "run string, written timestamp, model string, quantisation string, probe boolean, max_new_tokens int, temperature double, benchmark string, task string, prompt_type string, mutation string,"
    " tasks_requested int, truth_file string, truth_sha256 string, probe_package_bytes bigint, results_csv string, profile_log string, profiles_logged int, outcomes map<string,bigint>, notes string"
)
PROFILE = "full_sol string, test_input string, profile map<string,array<int>>, raw_reply string"
#: One result file: metrics by mutation or category, with a map of directions.
RESULT = "map<string, struct<incorrect_dir: map<string,bigint>, invalid_dir: map<string,bigint>, total_inconsistencies: bigint, total_inconsistency_comparisons: bigint, total_tasks: bigint>>"
#: What a log's reader takes for a missing cell.
MISSING = ("", "NA", "N/A", "NaN", "nan", "None", "null", "NULL", "n/a", "<NA>", "#N/A", "-nan", "-NaN", "#NA", "1.#IND", "1.#QNAN", "-1.#IND", "-1.#QNAN", "#N/A N/A")
SEED = 1234
