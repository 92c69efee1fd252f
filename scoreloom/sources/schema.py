"""The run tables: columns, keys and kinds.  Nested JSON is VARIANT."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

TEXT, INT, DOUBLE, BOOL, TIME, JSON = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType(), T.VariantType()


def needed(name: str, kind: T.DataType, refers_to: str | None = None) -> T.StructField:
    """A column that must have a value; ``refers_to`` names the table whose key it holds."""
    return T.StructField(name, kind, False, {"references": refers_to} if refers_to else {})


def optional(name: str, kind: T.DataType, refers_to: str | None = None) -> T.StructField:
    return T.StructField(name, kind, True, {"references": refers_to} if refers_to else {})


@dataclass(frozen=True)
class Table:
    name: str
    kind: str                                    # append | mutable | reference
    key: tuple[str, ...]
    columns: tuple[T.StructField, ...]

    @property
    def schema(self) -> T.StructType:
        return T.StructType(list(self.columns))

    @property
    def references(self) -> tuple[tuple[str, str], ...]:
        """(column, table)"""
        return tuple((f.name, f.metadata["references"]) for f in self.columns if "references" in f.metadata)

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.columns if not f.nullable]


# Names, types and keys of the stored tables.
TABLES: dict[str, Table] = {t.name: t for t in [
    Table("runs", "mutable", ("run_id",), (
        needed("run_id", TEXT),
        optional("name", TEXT),
        optional("dataset", TEXT),
        needed("task", TEXT),
        needed("mode", TEXT),
        needed("status", TEXT),
        optional("provider", TEXT),
        optional("model", TEXT),
        needed("config", JSON),
        optional("code_version", TEXT),
        optional("code_dirty", BOOL),
        needed("schema_version", INT),
        optional("summary", JSON),
        needed("created_at", TIME),
        needed("updated_at", TIME),
    )),
    Table("personas", "reference", ("persona_id",), (
        needed("persona_id", TEXT),
        needed("persona_set", TEXT),
        optional("persona_number", INT),
        optional("name", TEXT),
        needed("payload", JSON),
        needed("content_sha256", TEXT),
    )),
    Table("inputs", "append", ("input_id",), (
        needed("input_id", TEXT),
        needed("run_id", TEXT, "runs"),
        needed("input_index", INT),
        needed("input_type", TEXT),
        needed("payload", JSON),
        optional("persona_id", TEXT, "personas"),
        needed("created_at", TIME),
    )),
    Table("input_items", "append", ("input_id", "item_index"), (
        needed("input_id", TEXT, "inputs"),
        needed("run_id", TEXT, "runs"),
        needed("item_index", INT),
        needed("label", TEXT),
        needed("value", TEXT),
        optional("entity", TEXT),
        optional("qualifier", TEXT),
    )),
    Table("prompt_templates", "reference", ("template_sha256",), (
        needed("template_sha256", TEXT),
        needed("template_id", TEXT),
        needed("name", TEXT),
        needed("version", INT),
        optional("system_template", TEXT),
        needed("user_template", TEXT),
        needed("required", JSON),
        needed("optional", JSON),
        optional("description", TEXT),
        optional("changes", TEXT),
        optional("based_on", TEXT),
        optional("status", TEXT),
    )),
    Table("prompts", "append", ("prompt_id",), (
        needed("prompt_id", TEXT),
        needed("input_id", TEXT, "inputs"),
        needed("run_id", TEXT, "runs"),
        needed("template", TEXT),
        optional("template_sha256", TEXT, "prompt_templates"),
        optional("system", TEXT),
        needed("user_text", TEXT),
        needed("messages", JSON),
        needed("prompt_sha256", TEXT),
        needed("created_at", TIME),
    )),
    Table("requests", "append", ("request_id",), (
        needed("request_id", TEXT),
        needed("prompt_id", TEXT, "prompts"),
        needed("run_id", TEXT, "runs"),
        needed("provider", TEXT),
        optional("model", TEXT),
        needed("params", JSON),
        needed("extra_body", JSON),
        needed("mode", TEXT),
        needed("created_at", TIME),
    )),
    Table("batches", "mutable", ("batch_id",), (
        needed("batch_id", TEXT),
        needed("run_id", TEXT, "runs"),
        needed("provider", TEXT),
        needed("round", INT),
        optional("endpoint", TEXT),
        needed("status", TEXT),
        optional("raw_status", TEXT),
        needed("n_requests", INT),
        optional("request_counts", JSON),
        optional("input_file", TEXT),
        needed("collected", BOOL),
        needed("created_at", TIME),
        needed("updated_at", TIME),
    )),
    Table("responses", "append", ("response_id",), (
        needed("response_id", TEXT),
        needed("request_id", TEXT, "requests"),
        needed("run_id", TEXT, "runs"),
        needed("attempt", INT),
        optional("batch_id", TEXT, "batches"),
        optional("model", TEXT),
        optional("finish_reason", TEXT),
        optional("error", TEXT),
        optional("prompt_tokens", INT),
        optional("completion_tokens", INT),
        optional("total_tokens", INT),
        optional("cached_tokens", INT),
        needed("received_at", TIME),
    )),
    Table("response_texts", "append", ("response_id",), (
        needed("response_id", TEXT, "responses"),
        needed("run_id", TEXT, "runs"),
        optional("text", TEXT),
        optional("n_chars", INT),
    )),
    Table("validations", "append", ("response_id",), (
        needed("response_id", TEXT, "responses"),
        needed("run_id", TEXT, "runs"),
        optional("validator", TEXT),
        optional("passed", BOOL),
        optional("n_errors", INT),
        optional("n_warnings", INT),
        optional("validator_error", TEXT),
        optional("details", JSON),
    )),
    Table("validation_issues", "append", ("response_id", "issue_index"), (
        needed("response_id", TEXT, "responses"),
        needed("run_id", TEXT, "runs"),
        needed("issue_index", INT),
        needed("check_name", TEXT),
        needed("code", TEXT),
        needed("severity", TEXT),
        optional("label", TEXT),
        optional("message", TEXT),
        optional("data", JSON),
    )),
    Table("rubrics", "reference", ("rubric_sha256",), (
        needed("rubric_sha256", TEXT),
        needed("rubric_id", TEXT),
        needed("name", TEXT),
        needed("version", INT),
        optional("title", TEXT),
        needed("definition", JSON),
    )),
    Table("persona_expectations", "append", ("response_id",), (
        needed("response_id", TEXT, "responses"),
        needed("run_id", TEXT, "runs"),
        needed("persona_id", TEXT, "personas"),
        optional("context", JSON),
        optional("situation_summary", TEXT),
        optional("what_they_hoped_for", TEXT),
        optional("framing_preference", TEXT),
        optional("must_haves", JSON),
        optional("sensitivities", JSON),
    )),
    Table("evaluations", "append", ("evaluation_id",), (
        needed("evaluation_id", TEXT),
        needed("run_id", TEXT, "runs"),
        needed("response_id", TEXT, "responses"),
        needed("request_id", TEXT, "requests"),
        needed("subject_type", TEXT),
        needed("subject_response_id", TEXT),
        optional("subject_run_id", TEXT),
        optional("persona_id", TEXT, "personas"),
        needed("evaluator_type", TEXT),
        needed("rubric_id", TEXT),
        needed("rubric_sha256", TEXT, "rubrics"),
        optional("expectations", JSON),
        needed("section_scores", JSON),
        needed("score_before_caps", DOUBLE),
        optional("cap_applied", DOUBLE),
        needed("total_score", DOUBLE),
        needed("grade", TEXT),
        needed("n_red_flags", INT),
        optional("outputs", JSON),
        optional("subject_length_words", INT),
        needed("evaluated_at", TIME),
    )),
    Table("evaluation_item_scores", "append", ("evaluation_id", "item_key"), (
        needed("evaluation_id", TEXT, "evaluations"),
        needed("run_id", TEXT, "runs"),
        needed("item_key", TEXT),
        needed("item_id", TEXT),
        needed("section_key", TEXT),
        needed("item_type", TEXT),
        optional("label", TEXT),
        optional("score", INT),
        needed("is_na", BOOL),
        optional("justification", TEXT),
    )),
    Table("evaluation_red_flags", "append", ("evaluation_id", "flag_id"), (
        needed("evaluation_id", TEXT, "evaluations"),
        needed("run_id", TEXT, "runs"),
        needed("flag_id", TEXT),
        optional("severity", TEXT),
        optional("cap", DOUBLE),
        optional("quote", TEXT),
    )),
]}
