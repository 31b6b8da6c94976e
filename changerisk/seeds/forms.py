"""Statement forms: which leading words make which kind.

Keyed by the verb, or the verb and the object class for CREATE, ALTER and
DROP. Forms that need a closer look are refined in
:mod:`changerisk.functions.tagging`.
"""

from __future__ import annotations

FORMS = """
BEGIN = begin
START = begin
COMMIT = commit
END = commit
ROLLBACK = rollback
ABORT = rollback
SAVEPOINT = savepoint
RELEASE = release_savepoint
PREPARE = other
INSERT = insert
UPDATE = update
DELETE = delete
MERGE = merge
SELECT = select
WITH = select
VALUES = select
TABLE = select
COPY = copy_from
TRUNCATE = truncate
VACUUM = vacuum
ANALYZE = analyze
ANALYSE = analyze
CLUSTER = cluster
REINDEX = reindex
REFRESH = refresh_matview
LOCK = lock_table
SET = set
RESET = reset
SHOW = show
GRANT = grant
REVOKE = revoke
COMMENT = comment_on
CALL = call
DO = do_block
CREATE TABLE = create_table
CREATE INDEX = create_index
CREATE VIEW = create_view
CREATE MATERIALIZED VIEW = create_matview
CREATE SEQUENCE = create_sequence
CREATE TYPE = other
CREATE DOMAIN = create_domain
CREATE EXTENSION = create_extension
CREATE SCHEMA = create_schema
CREATE ROLE = create_role
CREATE USER = create_role
CREATE GROUP = create_role
CREATE FUNCTION = create_function
CREATE PROCEDURE = create_procedure
CREATE TRIGGER = create_trigger
CREATE POLICY = create_policy
CREATE RULE = create_rule
CREATE AGGREGATE = create_aggregate
CREATE STATISTICS = create_statistics
CREATE DATABASE = create_database
CREATE TABLESPACE = create_tablespace
CREATE FOREIGN TABLE = create_foreign_table
ALTER TABLE = alter_table
ALTER INDEX = alter_index
ALTER VIEW = alter_view
ALTER MATERIALIZED VIEW = alter_matview
ALTER FOREIGN TABLE = alter_foreign_table
ALTER SEQUENCE = alter_sequence
ALTER TYPE = alter_composite_type
ALTER DOMAIN = alter_domain
ALTER FUNCTION = alter_function
ALTER PROCEDURE = alter_function
ALTER ROUTINE = alter_function
ALTER ROLE = alter_role
ALTER USER = alter_role
ALTER SYSTEM = alter_system
ALTER DATABASE = alter_database
ALTER EXTENSION = alter_extension
ALTER POLICY = alter_policy
ALTER STATISTICS = alter_statistics
ALTER DEFAULT PRIVILEGES = alter_default_privileges
DROP TABLE = drop_table
DROP INDEX = drop_index
DROP VIEW = drop_view
DROP MATERIALIZED VIEW = drop_matview
DROP SEQUENCE = drop_sequence
DROP TYPE = drop_type
DROP DOMAIN = drop_domain
DROP EXTENSION = drop_extension
DROP TRIGGER = drop_trigger
DROP FUNCTION = drop_function
DROP ROUTINE = drop_function
DROP PROCEDURE = drop_procedure
DROP AGGREGATE = drop_aggregate
DROP SCHEMA = drop_schema
DROP POLICY = drop_policy
DROP ROLE = drop_role
DROP USER = drop_role
DROP GROUP = drop_role
DROP DATABASE = drop_database
DROP TABLESPACE = drop_tablespace
"""

# ALTER TABLE actions by their leading words, tried in order.
ACTION_FORMS = """
add_column_form               ^ADD\\s+COLUMN\\b
add_constraint_form           ^ADD\\s+(?:CONSTRAINT\\b|PRIMARY\\s+KEY\\b|UNIQUE\\b|FOREIGN\\s+KEY\\b|CHECK\\b|EXCLUDE\\b)
drop_constraint               ^DROP\\s+CONSTRAINT\\b
drop_column                   ^DROP\\s+(?:COLUMN\\s+)?(?:IF\\s+EXISTS\\s+)?(?:"[^"]+"|\\w+)
validate_constraint           ^VALIDATE\\s+CONSTRAINT\\b
alter_constraint              ^ALTER\\s+CONSTRAINT\\b
alter_column_type             ^ALTER\\s+(?:COLUMN\\s+)?\\S+\\s+(?:SET\\s+DATA\\s+)?TYPE\\b
set_column_default            ^ALTER\\s+(?:COLUMN\\s+)?\\S+\\s+SET\\s+DEFAULT\\b
drop_column_default           ^ALTER\\s+(?:COLUMN\\s+)?\\S+\\s+DROP\\s+DEFAULT\\b
set_not_null                  ^ALTER\\s+(?:COLUMN\\s+)?\\S+\\s+SET\\s+NOT\\s+NULL\\b
drop_not_null                 ^ALTER\\s+(?:COLUMN\\s+)?\\S+\\s+DROP\\s+NOT\\s+NULL\\b
add_identity                  ^ALTER\\s+(?:COLUMN\\s+)?\\S+\\s+ADD\\s+GENERATED\\b
drop_identity                 ^ALTER\\s+(?:COLUMN\\s+)?\\S+\\s+DROP\\s+IDENTITY\\b
set_expression                ^ALTER\\s+(?:COLUMN\\s+)?\\S+\\s+SET\\s+EXPRESSION\\b
drop_expression               ^ALTER\\s+(?:COLUMN\\s+)?\\S+\\s+DROP\\s+EXPRESSION\\b
set_statistics                ^ALTER\\s+(?:COLUMN\\s+)?\\S+\\s+SET\\s+STATISTICS\\b
set_storage                   ^ALTER\\s+(?:COLUMN\\s+)?\\S+\\s+SET\\s+STORAGE\\b
set_compression               ^ALTER\\s+(?:COLUMN\\s+)?\\S+\\s+SET\\s+COMPRESSION\\b
set_column_options            ^ALTER\\s+(?:COLUMN\\s+)?\\S+\\s+SET\\s*\\(
reset_column_options          ^ALTER\\s+(?:COLUMN\\s+)?\\S+\\s+RESET\\s*\\(
set_identity                  ^ALTER\\s+(?:COLUMN\\s+)?\\S+\\s+(?:SET|RESTART)\\b
enable_row_security           ^ENABLE\\s+ROW\\s+LEVEL\\s+SECURITY\\b
disable_row_security          ^DISABLE\\s+ROW\\s+LEVEL\\s+SECURITY\\b
no_force_row_security         ^NO\\s+FORCE\\s+ROW\\s+LEVEL\\s+SECURITY\\b
force_row_security            ^FORCE\\s+ROW\\s+LEVEL\\s+SECURITY\\b
disable_trigger               ^DISABLE\\s+TRIGGER\\b
enable_trigger                ^ENABLE\\s+(?:ALWAYS\\s+|REPLICA\\s+)?TRIGGER\\b
enable_rule                   ^ENABLE\\s+(?:ALWAYS\\s+|REPLICA\\s+)?RULE\\b
disable_rule                  ^DISABLE\\s+RULE\\b
set_logged                    ^SET\\s+LOGGED\\b
set_unlogged                  ^SET\\s+UNLOGGED\\b
set_tablespace                ^SET\\s+TABLESPACE\\b
set_access_method             ^SET\\s+ACCESS\\s+METHOD\\b
drop_cluster                  ^SET\\s+WITHOUT\\s+CLUSTER\\b
set_storage_params            ^SET\\s*\\(
reset_storage_params          ^RESET\\s*\\(
attach_partition              ^ATTACH\\s+PARTITION\\b
detach_partition_concurrently ^DETACH\\s+PARTITION\\s+\\S+\\s+CONCURRENTLY\\b
detach_partition_finalize     ^DETACH\\s+PARTITION\\s+\\S+\\s+FINALIZE\\b
detach_partition              ^DETACH\\s+PARTITION\\b
cluster_on                    ^CLUSTER\\s+ON\\b
change_owner                  ^OWNER\\s+TO\\b
no_inherit                    ^NO\\s+INHERIT\\b
inherit                       ^INHERIT\\b
not_of                        ^NOT\\s+OF\\b
of_type                       ^OF\\b
replica_identity              ^REPLICA\\s+IDENTITY\\b
add_column_form               ^ADD\\b
"""


def form_rows() -> list[tuple[str, str]]:
    return [tuple(part.strip() for part in line.split("="))  # type: ignore[misc]
            for line in FORMS.strip().splitlines()]


def action_rows() -> list[tuple[str, str]]:
    return [tuple(line.split(None, 1)) for line in ACTION_FORMS.strip().splitlines()]  # type: ignore[misc]
