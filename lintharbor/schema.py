"""The fixed schemas of all tables: findings, program structure, traces, seeds, crashes and campaign series."""

from __future__ import annotations

from pyspark.sql import types as T

FLAG = "tool string, file string, line int, vuln string"
GROUPED_FLAG = FLAG + ", n_flg_lines int, n_all_lines int, n_run_tools int, n_all_tools int, score double"
FRAME = "struct<id:int,file:string,function:string,line:int>"
CRASH = f"input_file string, sanitizer string, vuln_type string, stack_trace array<{FRAME}>"
_RANGE = "line:struct<start:bigint,`end`:bigint>"
INSPECTION = (
    f"functions array<struct<name:string,location:struct<filename:string,{_RANGE},reachable_from_main:boolean>,LoC:bigint,"
    f"basic_blocks:array<struct<id:bigint,location:struct<{_RANGE}>,LoC:bigint>>>>, iCFG array<struct<src:bigint,dst:array<bigint>>>"
)
SARIF = (
    "version string, runs array<struct<tool:struct<driver:struct<name:string,rules:array<struct<id:string,name:string>>>>,"
    "results:array<struct<ruleId:string,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string,uriBaseId:string>,region:struct<startLine:bigint>>>>>>>>"
)
FUNCTIONS = "func_ord int, file string, name string, start long, `end` long, loc long, reachable boolean"
BLOCKS = FUNCTIONS + ", block_ord int, block_id long, block_start long, block_end long, block_loc long"
TARGETS = "file string, line int, score float"
TRACE = "exec_id long, edge int, cnt int"
SEEDS = "seed_id long, len long, exec_us long, bitmap_size long, handicap int, depth int, distance double"
DISTANCES = "row int, col int, dist int"
CONDITIONS = "cnd_id int, cbb_id int, type1 string, type2 string, value1 string, value2 string"
SNAPSHOT_NUMBERS = (
    "start_time last_update fuzzer_pid cycles_done execs_done paths_total paths_favored paths_found paths_imported max_depth cur_path pending_favs pending_total "
    "variable_paths unique_crashes unique_hangs last_path last_crash last_hang execs_since_crash exec_timeout"
).split()
SNAPSHOT_RATES = "execs_per_sec stability bitmap_cvg".split()
PLOT = "unix_time long, cycles_done long, cur_path long, paths_total long, pending_total long, pending_favs long, map_size string, unique_crashes long, unique_hangs long, max_depth long, execs_per_sec double"
CAMPAIGN_STATS = "fuzzing_dur long, cycle_count long, fuzzing_mode string, init_cycle_length long, cycle_interval long, n_target_bbs long, n_target_bbs_hit long, n_target_bbs_finished long, n_unique_crashes long"
SUMMARY_COLUMNS = ("bug_id", "n_dedup_frames", "consider_filepaths", "consider_lines", "input_file", "sanitizer", "vuln_type", "stack_trace", "n_total_frames")
SUMMARY = f"bug_id int, n_dedup_frames int, consider_filepaths boolean, consider_lines boolean, {CRASH}"


def struct(ddl: str) -> T.StructType:
    """A DDL string as a StructType."""
    return T.StructType.fromDDL(ddl)
