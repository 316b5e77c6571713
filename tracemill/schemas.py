"""Schemas of the tables that the operators read and write (DDL strings; doubles for scores, never decimals)."""

MESSAGE = "struct<role:string,content:string>"
CASE = "struct<type:string,input:string,output:string,fn_name:string>"
SCORES = "struct<clarity:double,conciseness:double,informativeness:double,naturalness:double,overall:double>"

TRAIN_TASK = "task_id string, prompt string, test_cases array<string>, code_solution string, source string, benchmark string, synthetic boolean"
EVAL_TASK = "task_id string, prompt string, entry_point string, test_cases array<string>, n_base_tests bigint, n_plus_tests bigint, code_solution string, source string, benchmark string, synthetic boolean"
CASE_TASK = f"task_id string, prompt string, harness string, lcb_tests array<{CASE}>, test_cases array<string>, difficulty string, source string, benchmark string, dataset string, synthetic boolean"
#: The reward is read as text, since logs may hold a quoted number or a boolean.
AUDIT = "call string, task_id string, reward string, has_think_end boolean, has_python_fence boolean, completion_chars bigint, completion string"
TRACE = "task_id string, task_prompt string, full_output string, thinking string, code string, collaboration string, reward double, work_trace string, source string, audit_call bigint, audit_file string"
RAW_PAIR = "task_id string, task_prompt string, thinking string, code string, rl_collaboration string, regen_collaboration string, reward double, full_output string, work_trace string"
PREFERENCE = f"chosen string, rejected string, messages array<{MESSAGE}>, metadata struct<task_id:string,task_prompt:string,thinking:string,code:string,prompt_format:string,regen_score:{SCORES},rl_score:{SCORES},reward:double,score_gap:double>"
RENDERED = "prompt string, chosen string, rejected string"
EVAL_METRICS = "mbpp_plus_pass1 double, avg_code_length double, syntax_error_rate double, lcb_easy_pass1 double, lcb_ready_frac double, readability_overall double, avg_collab_length double, think_leak_rate double"
PROGRESS_EVENT = "step bigint, elapsed string, eta string, sec_per_it double"
METRIC_EVENT = "loss double, grad_norm double, learning_rate double, reward double, reward_std double, completion_length double, kl double, epoch double"
#: Score dimensions in order; overall is last.
SCORE_KEYS = ("clarity", "conciseness", "informativeness", "naturalness", "overall")
