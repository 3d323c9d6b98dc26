"""The rows that queries over literal inputs must give, as VALUES for DuckDB: taken from a run, then looked over by hand (scores of ranking and chains only by their order)."""

from __future__ import annotations

ROWS: dict[str, tuple[str, list[tuple]]] = {
    "frame_parse": (
        "bug_id string, line_no int, format string, index int, function string, file string, line int, column int, module string, instruction string",
        [
            ('b1', 3, 'sanitizer', 0, 'put_bytes', '/work/lib/store.c', 41, 9, None, None),
            ('b1', 4, 'module', 1, 'handle', None, None, None, '/work/app', '4f1c00'),
            ('b1', 5, 'sanitizer', 2, 'main', '/work/app/main.c', 12, None, None, None),
            ('b2', 1, 'debugger', 0, 'put_bytes (n=4)', 'lib/store.c', 41, None, None, None),
            ('b2', 2, 'debugger', 1, 'main ()', 'app/main.c', 12, 3, None, None),
            ('b2', 3, 'parenthesis', 2, 'walk', 'lib/tree.c', 7, 1, None, None),
        ],
    ),
    "sanitizer_parse": (
        "bug_id string, summary string, access string, bug_type string, file string, line int, column int, function string",
        [
            ('b1', 'AddressSanitizer: heap-buffer-overflow', 'write', 'buffer_overflow', '/work/lib/store.c', 41, 9, 'put_bytes'),
            ('b2', None, None, None, 'lib/store.c', 41, None, 'put_bytes (n=4)'),
        ],
    ),
    "diagnostics_parse": (
        "bug_id string, line_no int, file string, line int, column int, message string",
        [
            ('b1', 2, 'lib/x.c', 12, 5, "'n' undeclared"),
            ('b1', 4, 'lib/y.c', 1, 2, 'no such file'),
        ],
    ),
    "diff_parse": (
        "patch_id string, file string, hunk int, header string, old_start int, new_start int, pos int, kind string, text string, old_no int, new_no int",
        [
            ('p1', 'lib/store.c', 1, 'static int put_bytes(char *p, int n)', 38, 38, 1, 'context', '{', 38, 38),
            ('p1', 'lib/store.c', 1, 'static int put_bytes(char *p, int n)', 38, 38, 2, 'del', '    int room = n + 1;', 39, None),
            ('p1', 'lib/store.c', 1, 'static int put_bytes(char *p, int n)', 38, 38, 3, 'add', '    int room = n * 4 + 1;', None, 39),
            ('p1', 'lib/store.c', 1, 'static int put_bytes(char *p, int n)', 38, 38, 4, 'add', '    if (room < n)', None, 40),
            ('p1', 'lib/store.c', 1, 'static int put_bytes(char *p, int n)', 38, 38, 5, 'add', '        return -1;', None, 41),
            ('p1', 'lib/store.c', 1, 'static int put_bytes(char *p, int n)', 38, 38, 6, 'context', '    char *to = grow(p, room);', 40, 42),
            ('p1', 'lib/store.c', 1, 'static int put_bytes(char *p, int n)', 38, 38, 7, 'context', '}', 41, 43),
        ],
    ),
    "patch_intent": (
        "patch_id string, intent string, direct_fix double, defensive_guard double, compensating_check double, cleanup double, refactor double",
        [
            ('p1', 'direct_fix', 0.85, 0.4125, 0.55, 0.0, 0.0),
        ],
    ),
    "lex_facts": (
        "repo_id string, file string, function_id string, func string, fact string, statement_id string, text string, qualified_name string, return_type string, callee string, alias_source string, condition string, returned string, line bigint, end_line bigint, block_depth bigint, parameters string, statement_types string, defined string, referenced string, calls string, memory_kinds string, memory_functions string, memory_targets string, field_accesses string, index_variables string, macro_references string, call_arguments string, arguments string",
        [
            ('r', 'lib/store.c', 'lib/store.c:grow:7:151', 'grow', 'call', 'lib/store.c:grow:7:151:13', None, None, None, 'memset', None, None, None, 13, None, None, None, None, None, None, None, None, None, None, None, None, None, None, 'to>0>len'),
            ('r', 'lib/store.c', 'lib/store.c:grow:7:151', 'grow', 'call', 'lib/store.c:grow:7:151:9', None, None, None, 'realloc', None, None, None, 9, None, None, None, None, None, None, None, None, None, None, None, None, None, None, 'p>len'),
            ('r', 'lib/store.c', 'lib/store.c:grow:7:151', 'grow', 'function', None, None, 'grow', 'char *', None, None, None, None, 7, 15, None, 'p>len', None, None, None, None, None, None, None, None, None, None, None, None),
            ('r', 'lib/store.c', 'lib/store.c:grow:7:151', 'grow', 'statement', 'lib/store.c:grow:7:151:10', 'if (to == NULL) {', None, None, None, None, 'to == NULL', None, 10, None, 0, None, 'condition', '', 'to', '', '', '', '', '', '', 'NULL', '', None),
            ('r', 'lib/store.c', 'lib/store.c:grow:7:151', 'grow', 'statement', 'lib/store.c:grow:7:151:11', 'return NULL;', None, None, None, None, None, 'NULL', 11, None, 1, None, 'return', '', '', '', '', '', '', '', '', 'NULL', '', None),
            ('r', 'lib/store.c', 'lib/store.c:grow:7:151', 'grow', 'statement', 'lib/store.c:grow:7:151:13', 'memset(to, 0, len);', None, None, None, None, None, None, 13, None, 0, None, 'function_call>memory_operation', '', 'to>len', 'memset', 'set', 'memset', 'to', '', '', '', 'to>0>len', None),
            ('r', 'lib/store.c', 'lib/store.c:grow:7:151', 'grow', 'statement', 'lib/store.c:grow:7:151:14', 'return to;', None, None, None, None, None, 'to', 14, None, 0, None, 'return', '', 'to', '', '', '', '', '', '', '', '', None),
            ('r', 'lib/store.c', 'lib/store.c:grow:7:151', 'grow', 'statement', 'lib/store.c:grow:7:151:9', 'char *to = realloc(p, len);', None, None, None, None, None, None, 9, None, 0, None, 'assignment>function_call>memory_operation>declaration', 'to', 'p>len', 'realloc', 'reallocation', 'realloc', 'to', '', '', '', 'p>len', None),
            ('r', 'lib/store.c', 'lib/store.c:room_for:2:56', 'room_for', 'function', None, None, 'room_for', 'static int', None, None, None, None, 2, 5, None, 'count>width', None, None, None, None, None, None, None, None, None, None, None, None),
            ('r', 'lib/store.c', 'lib/store.c:room_for:2:56', 'room_for', 'statement', 'lib/store.c:room_for:2:56:3', 'int total = count * width; // no check', None, None, None, None, None, None, 3, None, 0, None, 'assignment>declaration', 'total', 'count>width', '', '', '', '', '', '', '', '', None),
            ('r', 'lib/store.c', 'lib/store.c:room_for:2:56', 'room_for', 'statement', 'lib/store.c:room_for:2:56:4', 'return total;', None, None, None, None, None, 'total', 4, None, 0, None, 'return', '', 'total', '', '', '', '', '', '', '', '', None),
        ],
    ),
    "template_normalise": (
        "snippet string, template string",
        [
            ('12: memcpy(dst, src, total_len + 4);', '<copy_op>(<buffer_var>, <buffer_var>, <size_var> + <int>);'),
            ('call(name, other, name, "text", NULL);', '<var1>(<var2>, <var3>, <var2>, <str>, <null>);'),
        ],
    ),
    "reference_urls": (
        "url string, kind string, provider string, repo_url string, commit_sha string, pull_request string, issue_id string",
        [
            ('ftp://h/p', 'other', 'other', None, None, None, None),
            ('https://github.com/a/b/compare/v1...deadbeef01', 'compare', 'github', 'https://github.com/a/b', 'deadbeef01', None, None),
            ('https://github.com/a/b/issues/3', 'issue', 'github', 'https://github.com/a/b', None, None, '3'),
            ('https://gitlab.com/g/s/p/-/merge_requests/7', 'pull_request', 'gitlab', 'https://gitlab.com/g/s/p', None, '7', None),
            ('ttps://github.com/a/b/commit/ABCDEF1234567', 'commit', 'github', 'https://github.com/a/b', 'abcdef1234567', None, None),
            ('www.example.org/x/y.git', 'repository', 'other', 'https://www.example.org/x/y', None, None, None),
        ],
    ),
    "root_cause_ranking": (
        "bug_id string, rank int, node_id string, line int, label string, score double, matched_bug_pattern string, cve_pattern_prior_score double",
        [
            ('m', 1, 'm1', 5, 'root_cause_candidate', 1.0, 'incorrect_size_computation', 0.977),
            ('m', 2, 'm2', 12, 'propagation', 0.4367, 'none', 0.0),
            ('m', 3, 'm3', 22, 'symptom', 0.0, 'invalid_initialization', 0.0),
            ('n', 1, 'n1', 5, 'root_cause_candidate', 1.0, 'incorrect_size_computation', 0.977),
            ('n', 2, 'n2', 12, 'propagation', 0.4717, 'none', 0.0),
            ('n', 3, 'n3', 22, 'symptom', 0.0, 'invalid_initialization', 0.0),
            ('u', 1, 'u1', 3, 'root_cause_candidate', 1.0, 'ownership_or_lifetime_operation', 0.8875),
            ('u', 2, 'u2', 9, 'symptom', 0.0038, 'invalid_state_update', 0.0),
        ],
    ),
    "causal_chains": (
        "bug_id string, rank int, root_node string, root_rank int, path string, relations string, score double",
        [
            ('m', 1, 'm1', 1, 'm1>m2>m3', 'data_flow>call_argument', 0.8457),
            ('m', 2, 'm2', 2, 'm2>m3', 'call_argument', 0.4532),
            ('m', 3, 'm3', 3, 'm3', '', 0.06),
            ('n', 1, 'n1', 1, 'n1>n2>n3', 'data_flow>call_argument', 0.8558),
            ('n', 2, 'n2', 2, 'n2>n3', 'call_argument', 0.4532),
            ('n', 3, 'n3', 3, 'n3', '', 0.06),
            ('u', 1, 'u1', 1, 'u1>u2', 'ownership_transfer', 0.7831),
            ('u', 2, 'u2', 2, 'u2', '', 0.0627),
        ],
    ),
    "case_reports": (
        "case_id string, build_cmd string, build_dir string, cmd string, trace_path string, fix_commit string, file string, line int, col int, function string, hint string, summary string, access string, places int",
        [
            ('c1', 'make', 'out', './a', 'own.txt', 'abc', 'lib/store.c', 41, 9, 'put_bytes', 'buffer_overflow', 'AddressSanitizer: heap-buffer-overflow', 'write', 2),
            ('c2', None, None, './c', None, None, 'app/main.c', 12, 5, 'main', 'use_after_free', None, None, 3),
            ('c3', None, None, None, None, None, 'x.c', None, None, None, None, None, None, 0),
            ('c4', None, None, None, None, None, None, None, None, None, None, None, None, 0),
        ],
    ),
    "config_overlay": (
        "case_id string, top_k string, seed string, n int",
        [
            ('a', '7', '2', 2),
            ('b', '5', None, 1),
            ('c', '3', '9', 2),
        ],
    ),
    "artifact_check": (
        "path string, case_id string, kind string, reason string",
        [
            ('a.diff', 'c1', 'file', 'kept'),
            ('a.diff', 'c3', 'directory', 'not_a_directory'),
            ('gone', 'c2', 'file', 'missing'),
            ('out', 'c1', 'directory', 'kept'),
            ('out', 'c3', 'file', 'not_a_file'),
        ],
    ),
    "judged_candidates": (
        "node_id string, used_patch boolean, evidence_density double, verdict string, reasoning string, fallback boolean, judged_confidence double",
        [
            ('n1', True, 1.0, 'root_cause_candidate', 'it writes past the end of the buffer', False, 0.8775),
            ('n2', False, 0.5, 'propagation', '', True, 0.0),
            ('n3', False, 0.0, 'symptom', 'short', False, 0.4125),
            ('n4', False, 0.0, 'propagation', '', True, 0.0),
        ],
    ),
    "prompt_keys": (
        "node_id string, payload string, prompt_key string",
        [
            ('n1', '{"code":"free(p);","line":3}', '37498e25899da73743768bef4a08612f94f855f9c965307c02da8c40cb2bb55b'),
            ('n2', '{"line":4}', '2ebdf9e1237b8002cf64faa2faca9772bb683d0b9bc0a5817c2db1c1f1471c74'),
        ],
    ),
    "validated_replies": (
        "id string, verdict string, merge string, confidence double, assessments string, ranks string, passed boolean",
        [
            ('a', 'accept', 'replace_original', 0.9, '2/root_cause,1/symptom_or_noise', '2', True),
            ('b', 'accept_with_lower_confidence', 'append_as_alternative', 1.0, '', '3,1', True),
            ('c', 'manual_review', 'do_not_merge', 0.0, '1/plausible_root_cause', '1', False),
            ('d', 'accept', 'do_not_merge', 0.9, '', '1', False),
        ],
    ),
    "refinement_plan": (
        "cve_id string, candidates string, patterns string, action string, priority double, bucket string",
        [
            ('r1', 'retain_candidate', 'keep_pattern_signal', 'rerun_slice_from_patch_context', 88.5, 'high'),
            ('r2', 'recheck_with_more_context', 'specialize_pattern', 'specialize_root_cause_pattern', 41.0, 'low'),
            ('r3', 'replace_candidate', 'avoid_or_split_pattern', 'manual_review_due_to_weak_evidence', 30.5, 'low'),
            ('r4', 'demote_symptom_or_noise', 'specialize_pattern', 'rerun_slice_from_patch_context', 47.0, 'low'),
            ('r5', 'recheck_with_more_context', 'keep_pattern_signal', 'retain_but_lower_confidence', 0.0, 'low'),
        ],
    ),
    "query_terms": (
        "cve_id string, terms string",
        [
            ('r1', 'buffer_overflow,size,size_t,wrong'),
            ('r2', ''),
        ],
    ),
    "rescored_candidates": (
        "cve_id string, file string, line int, bonus double, penalty double, refined_score double, refined_rank int",
        [
            ('r', 'a.c', 5, 0.42, 0.0, 0.92, 1),
            ('r', 'a.c', 9, 0.21, 0.0, 0.81, 2),
            ('s', 'a.c', 5, 0.0, 0.0, 0.2, 1),
        ],
    ),
    "refinement_starts": (
        "cve_id string, rank int, reason string",
        [
            ('r', 1, 'demote_symptom_or_noise'),
            ('r', 3, 'recheck'),
            ('s', 1, 'fallback_existing_candidate'),
        ],
    ),
    "refined_dataset_rows": (
        "cve_id string, rank int, new_rank int",
        [
            ('r', 2, 1),
            ('r', 3, 2),
            ('s', 4, 1),
        ],
    ),
    "record_inference": (
        "cve_id string, language string, name string, relevant boolean, notes int, sources string, words string",
        [
            ('v1', 'cpp', 'lib', True, 0, 'cpe:x', ''),
            ('v2', 'unknown', 'prod', True, 3, '<2', ''),
            ('v3', 'c', 'proj', True, 1, '', 'overflow'),
            ('v4', 'unknown', 'unknown_project', False, 3, '', ''),
        ],
    ),
    "fix_commit_candidates": (
        "record string, rank int, commit_sha string, url string, summary string, score double, matched_by string, evidence string",
        [
            ('v', 1, 'aa', 'u1', 'Fix', 1.0, 'normalized_fix_commit,reference_commit', 'u1'),
            ('v', 2, 'cc', None, 'x', 0.95, 'normalized_fix_commit', 'u9'),
            ('w', 1, 'dd', None, None, 0.25, 'keyword_search', ''),
        ],
    ),
    "patch_types": (
        "patch_id string, patch_type string",
        [
            ('p1', 'bounds_fix'),
            ('p2', 'added_check'),
            ('p3', 'refactor'),
            ('p4', 'cleanup'),
            ('p5', 'bounds_fix'),
            ('p6', 'direct_fix'),
            ('p7', 'cleanup'),
            ('p8', 'added_check'),
        ],
    ),
    "patch_anchors": (
        "patch_id string, file string, line int, kind string, tier int",
        [
            ('p1', 'lib/store.c', 39, 'removed_statement', 0),
            ('p2', 'lib/store.c', 93, 'removed_statement', 1),
            ('p3', 'lib/store.c', 39, 'insertion_site', 2),
            ('p3', 'lib/store.c', 40, 'insertion_site', 2),
            ('p4', 'lib/store.c', 40, 'patch_context', 3),
            ('p5', 'lib/store.c', 93, 'removed_statement', 4),
            ('p6', 'lib/none.c', 1, 'insertion_site', 9),
        ],
    ),
    "anchor_traits": (
        "id string, operation string, bug string, names string",
        [
            ('a', 'memcpy', 'use_after_free', 'a,b,free,memcpy,p,x'),
            ('b', 'strncpy', 'null_dereference', 'a,free,strncpy'),
            ('c', None, 'buffer_overflow', ''),
        ],
    ),
    "patch_relations": (
        "id int, patch_anchor_overlap boolean, same_file_as_patch boolean, same_function_as_patch boolean, defines_value_later_fixed boolean, missing_check_replaced boolean, incorrect_computation_replaced boolean, upstream_from_patch boolean, patch_relation string",
        [
            (1, False, True, True, True, False, False, True, 'same_function_as_patch'),
            (2, True, True, True, True, True, True, False, 'patch_anchor_overlap'),
            (3, False, True, False, False, False, True, False, 'same_file_as_patch'),
            (4, False, False, False, False, True, False, True, 'upstream_of_patch'),
            (5, False, False, False, False, False, False, True, 'outside_patched_files'),
            (6, False, True, True, False, False, False, True, 'patched_statement'),
            (7, False, True, False, False, False, False, False, 'same_file_as_patch'),
        ],
    ),
    "changed_lines": (
        "kind string, line int, func string, text string",
        [
            ('add', 39, 'put_bytes', 'int room = n * 4 + 1;'),
            ('add', 40, 'put_bytes', 'if (room < n)'),
            ('add', 40, 'put_bytes', 'return -1;'),
            ('del', 39, 'put_bytes', 'int room = n + 1;'),
        ],
    ),
    "hunk_parts": (
        "patch_id string, file string, old_start int, function string, added string, removed string",
        [
            ('p1', 'lib/store.c', 38, 'put_bytes', 'int room = n * 4 + 1;|if (room < n)|return -1;', 'int room = n + 1;'),
        ],
    ),
    "pattern_library_summary": (
        "patterns bigint, least bigint, most bigint, total bigint, category string, operation_type string",
        [
            (3, 2, 9, 16, 'size', 'guard'),
        ],
    ),
    "initial_labels": (
        "id string, label string, explanation string",
        [
            ('a', 'symptom', 'This location is close to the observable failure and mostly consumes already-propagated state.'),
            ('b', 'symptom', 'This location is close to the observable failure and mostly consumes already-propagated state.'),
            ('c', 'propagation', 'This statement participates in propagation toward the trigger but is less likely to be the original state introduction site.'),
            ('d', 'root_cause_candidate', 'This upstream statement introduces or updates x, y and matches the size heuristic.'),
            ('e', 'root_cause_candidate', 'This upstream statement likely introduces state that later propagates to the trigger through relevant state.'),
            ('f', 'propagation', 'This statement participates in propagation toward the trigger but is less likely to be the original state introduction site.'),
        ],
    ),
    "expert_prior": (
        "id string, expert_id string, expert_rca_prior_score double, pattern_score double",
        [
            ('n1', 'e1', 0.6292, 0.550336),
            ('n2', 'e2', 0.2992, 1.0),
            ('n3', None, 0.0, 0.3),
            ('n4', 'e1', 0.1542, 0.212336),
        ],
    ),
    "patched_chains": (
        "bug_id string, old_rank int, root_rank int, score double, alignment double, patch_supported boolean, rank int",
        [
            ('b', 1, 2, 0.84, 0.0, False, 2),
            ('b', 2, 1, 0.96, 0.66, True, 1),
            ('b', 3, 3, 0.62, 0.72, True, 3),
            ('c', 1, 1, 1.0, 1.0, True, 1),
        ],
    ),
    "crash_reports": (
        "id string, state string, target string, testcase string",
        [
            ('a', 'read_chunk,ns::Image<T>::load(int)', 'png_fuzz', '123456'),
            ('b', '', None, None),
            ('c', '', None, None),
            ('d', 'f', None, None),
        ],
    ),
    "function_name_variants": (
        "name string, variants string",
        [
            ('int run', 'int run|run'),
            ('ns::Image<T>::load(int)', 'ns::Image::load(int)|load'),
            ('plain', 'plain'),
        ],
    ),
    "prediction_counts": (
        "n bigint, nonempty bigint, encoded bigint, diff_like bigint, code_like bigint",
        [
            (6, 4, 1, 2, 1),
        ],
    ),
    "kept_records": (
        "cve_id string, recommended_action string, keep boolean",
        [
            ('v1', 'keep', True),
            ('v2', 'drop', False),
            ('v3', 'keep_with_lower_confidence', True),
            ('v4', 'not_validated', True),
        ],
    ),
    "validation_counts": (
        "label string, recommended_action string, n bigint, kept bigint, confidence double",
        [
            ('noisy', 'drop', 1, 0, None),
            ('valid', 'keep', 2, 2, 0.65),
            ('valid', 'manual_review', 1, 0, 0.1),
        ],
    ),
    "ablation_variants": (
        "id int, chains string, candidates string, variant string",
        [
            (1, 'c', 'p', 'full'),
            (1, 'c', None, 'without_candidates'),
            (1, None, 'p', 'without_chains'),
        ],
    ),
    "repository_paths": (
        "cve_id string, repo_url string, project string, path string",
        [
            ('v1', 'u1', 'p1', '/own'),
            ('v2', 'u1', 'p1', '/url'),
            ('v3', 'u9', 'p1', '/project'),
            ('v4', None, None, None),
        ],
    ),
    "case_patterns": (
        "id string, pattern string, operation string",
        [
            ('a', 'own_pattern', 'state_update'),
            ('b', 'invalid_initialization', 'initialization'),
            ('c', 'ownership_or_lifetime_operation', 'lifetime_management'),
            ('d', 'validation_or_guard_issue', 'guard_check'),
            ('e', 'invalid_state_update', 'state_update'),
        ],
    ),
    "unfixed_sources": (
        "id string, source string",
        [
            ('n', None),
            ('s', 'a|broken|old|#ifdef OTHER|b|#endif|'),
        ],
    ),
    "feed_records": (
        "cve_id string, description string, cwes string, refs string, project string, source_kind string",
        [
            ('CVE-2021-1', 'new', 'CWE-416', 'https://h/1', None, 'nvd'),
            ('CVE-2021-2', 'old', 'CWE-787', 'https://www.h.org', None, 'nvd'),
            ('CVE-2021-4', None, 'CWE-20', 'http://h/x', 'p', 'project_advisory'),
        ],
    ),
    "feed_products": (
        "cve_id string, cpe_uri string, vendor string, product string, version string",
        [
            ('CVE-2021-1', 'cpe:2.3:a:v:p:1.0:*', 'v', 'p', '1.0'),
            ('CVE-2021-1', 'cpe:2.3:a:v:q:*:*', 'v', 'q', None),
            ('CVE-2021-2', 'cpe:2.3:a:w:r:2:*', 'w', 'r', '2'),
        ],
    ),
}


def _literal(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)


def _values(schema: str, rows: list[tuple]) -> str:
    kinds = {"string": "varchar"}
    columns = [c.split(" ") for c in schema.split(", ")]
    given = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    cast = ", ".join(f'cast(c{i} as {kinds.get(kind, kind)}) as "{name}"' for i, (name, kind) in enumerate(columns))
    return f"select {cast} from (values {given}) v({', '.join(f'c{i}' for i in range(len(columns)))})"


#: A log read to its end: the best event of each user.
STREAM = """
select user_id, event_id, quality from (
  select *, row_number() over (partition by user_id order by quality desc, value desc, event_id desc) as n
  from (select *, case event_type when 'purchase' then 100 when 'signup' then 20 when 'click' then 15 else 10 end as quality from events)
) where n = 1
"""

ORACLE_SQL: dict[str, str] = {name: _values(*given) for name, given in ROWS.items()} | {"stream_resume": STREAM}
