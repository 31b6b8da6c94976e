"""Column contracts of the tables the operators exchange."""

from __future__ import annotations

ACTION = (
    "struct<kind:string,column:string,column_type:string,constraint_name:string,"
    "not_null:boolean,not_valid:boolean,has_using:boolean,using_index:string,"
    "missing_ok:boolean,referenced_table:string,partition:string,"
    "default_volatility:string,default_expression:string,unknown_functions:array<string>>"
)

# One row per statement. Inner statements of a procedural block are rows too:
# they share the block's ``idx`` and count from 1 in ``inner_pos``.
STATEMENTS = f"""
file_id string, idx bigint, inner_pos int, line bigint, kind string, sql string,
targets array<string>, actions array<{ACTION}>, attrs map<string,string>,
referenced_tables array<string>, partition_of string, index_name string,
index_method string, has_expression boolean, new_name string, missing_ok boolean,
in_block boolean, conditional boolean, opaque boolean, db_id bigint
"""

FACT = "struct<available:boolean,value:{0},reason:string>"
INDEX = ("struct<name:string,valid:boolean,size_bytes:struct<available:boolean,value:bigint,"
         "reason:string>,method:string,partial:boolean,has_expressions:boolean,"
         "default_opclasses:boolean,depends_on:array<string>>")
COLUMN = ("struct<name:string,attnum:int,data_type:string,not_null:boolean,has_default:boolean,"
          "identity:string,generated:string,is_domain:boolean>")
CONSTRAINT = ("struct<name:string,contype:string,validated:boolean,columns:array<string>,"
              "check_expression:string,referenced_table:string>")

RELATION_FACTS = "struct<" + ",".join(
    f"{name}:{FACT.format(type_)}" for name, type_ in [
        ("exists", "boolean"), ("reltuples", "bigint"), ("n_mod", "bigint"),
        ("last_analyze", "timestamp"), ("last_autoanalyze", "timestamp"),
        ("size_bytes", "bigint"), ("indexes", f"array<{INDEX}>"),
        ("columns", f"array<{COLUMN}>"), ("constraints", f"array<{CONSTRAINT}>"),
    ]) + ">"

TYPE_FACTS = "struct<" + ",".join(
    f"{name}:{FACT.format(type_)}" for name, type_ in [
        ("exists", "boolean"), ("is_domain", "boolean"), ("domain_not_null", "boolean"),
        ("domain_constraint_count", "bigint"),
    ]) + ">"

TYPE_CHANGE_FACTS = "struct<" + ",".join(
    f"{name}:{FACT.format(type_)}" for name, type_ in [
        ("current_type", "string"), ("current_is_domain", "boolean"), ("new_type", "string"),
        ("new_is_domain", "boolean"), ("new_domain_not_null", "boolean"),
        ("new_domain_constraint_count", "bigint"), ("new_domain_has_typmod", "boolean"),
        ("same_type", "boolean"), ("bases_same", "boolean"), ("cast_method", "string"),
    ]) + ">"

# Snapshot tables, one row per key.
RELATIONS = f"db_id bigint, relation string, facts {RELATION_FACTS}"
SERVERS = (f"db_id bigint, pg_version int, server_now {FACT.format('timestamp')}, "
           f"probe {FACT.format('bigint')}")
TYPES = f"db_id bigint, type_name string, type_facts {TYPE_FACTS}"
TYPE_CHANGES = ("db_id bigint, relation string, column string, new_type string, "
                f"change {TYPE_CHANGE_FACTS}")
FUNCTIONS = f"db_id bigint, function string, volatility {FACT.format('string')}"
WAITERS = ("db_id bigint, relation string, blocked_pid int, blocked_mode string, "
           "blocking_modes array<string>, all_idle " + FACT.format("boolean"))

# Evaluation and measurement records.
RESULTS = """
case_id string, idx bigint, family string, adversarial string, kind string,
predicted string, refusal string, refused_from string, deciding_kind string,
constant_key string, high_ms bigint, error boolean, level int, work_ms bigint,
wait_ms bigint, wall_ms bigint, is_dml boolean, rows_touched bigint, irreversible boolean
"""
