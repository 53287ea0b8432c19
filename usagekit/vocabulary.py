"""Names of the product's events, tools, segments and regions.

Operators take a ``Vocabulary`` so another product's log can be analysed with its own names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------------------------
# Event names, tool names and codes of the analysed product.
# ---------------------------------------------------------------------------------------------
TOOL_EVENT_PREFIX = "agent_tool_call_"
TOOLS = (
    "create_block_tool",
    "run_block_tool",
    "get_block_tool",
    "get_canvas_summary_tool",
    "refactor_block_tool",
    "finish_ticket_tool",
    "get_variable_preview_tool",
    "delete_block_tool",
    "create_edges_tool",
    "get_block_image_tool",
)
TOOL_LABELS = {
    "create_block_tool": "CREATE",
    "run_block_tool": "RUN",
    "get_block_tool": "GET",
    "get_canvas_summary_tool": "SUMMARY",
    "refactor_block_tool": "REFACTOR",
    "finish_ticket_tool": "FINISH",
    "get_variable_preview_tool": "PREVIEW",
    "delete_block_tool": "DELETE",
    "create_edges_tool": "EDGES",
}
TRANSITION_STATES = ("CREATE", "RUN", "GET", "REFACTOR", "FINISH", "SUMMARY", "PREVIEW", "DELETE")
WORKER_TOOL = "Coder Agent"
BUILD_TOOLS = ("create_block_tool", "refactor_block_tool")
SIGN_UP = "sign_up"
SIGN_IN = "sign_in"
RUNS = ("run_block", "run_all_blocks")
PARTIAL_RUNS = ("run_from_block", "run_upto_block")
AGENT_START = ("agent_new_chat", "agent_start_from_prompt", "agent_message")
STRUCTURAL = (
    "block_create",
    "block_delete",
    "block_copy",
    "block_paste",
    "block_rename",
    "block_resize",
    "edge_create",
    "edge_delete",
    "layer_create",
    "layer_delete",
    "layer_rename",
    "layer_duplicate",
    "canvas_create",
    "canvas_clone",
    "canvas_rename",
    "canvas_delete",
)
DEPENDENCY = (
    "requirements_build",
    "files_upload",
    "files_download",
    "files_update_lazy_load",
    "files_delete",
    "files_create_folder",
    "asset_add_to_canvas",
    "asset_create_connection",
)
OUTPUT = (
    "fullscreen_preview_output",
    "fullscreen_open",
    "block_output_download",
    "block_output_copy",
    "app_publish",
    "api_deploy",
    "hosted_apps_deploy",
)
ERROR_ASSIST = "agent_open_error_assist"
CREDITS_EXCEEDED = "credits_exceeded"
CREDIT_USE = ("credits_used", "addon_credits_used")
CREDIT_WARNINGS = ("credits_below_1", "credits_below_2", "credits_below_3", "credits_below_4")
EVENT_FUNNEL = (
    "sign_up",
    "skip_onboarding_form",
    "canvas_onboarding_tour_finished",
    "block_create",
    "run_block",
    "agent_new_chat",
    "agent_accept_suggestion",
    "agent_block_created",
    "requirements_build",
    "fullscreen_preview_output",
)
SEGMENTS = ("Agent Builder", "Agent Runner", "Manual Coder", "Viewer", "Ghost")
EU_COUNTRIES = (
    "AT", "BE", "BG", "HR", "CY", "CZ", "DK", "EE", "FI", "FR", "DE", "GR", "HU", "IE",
    "IT", "LV", "LT", "LU", "MT", "NL", "PL", "PT", "RO", "SK", "SI", "ES", "SE",
)
HYPOTHESIS_COUNTRIES = ("IN", "US", "GB", "IE", "FR", "NL")
CANVAS_PATTERN = r"/canvas/([a-f0-9\-]{10,})"
COMPLEXITY_WEIGHTS = {
    "structural_actions": 1.0,
    "agent_build_actions": 1.8,
    "execution_actions": 1.2,
    "dependency_actions": 1.3,
    "output_actions": 0.8,
    "active_days": 0.6,
}
# ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Vocabulary:
    """Named event sets. The feature matrix and the event-level reports use different sets for
    manual runs, outputs and credits, so both versions are kept apart."""

    sign_up: str = SIGN_UP
    sign_in: str = SIGN_IN
    tool_prefix: str = TOOL_EVENT_PREFIX
    tools: tuple[str, ...] = TOOLS
    tool_labels: dict[str, str] = field(default_factory=lambda: dict(TOOL_LABELS))
    worker_tool: str = WORKER_TOOL
    build_tools: tuple[str, ...] = BUILD_TOOLS
    runs: tuple[str, ...] = RUNS
    all_runs: tuple[str, ...] = RUNS + PARTIAL_RUNS
    execution_extra: tuple[str, ...] = ("agent_block_run",)
    agent_start: tuple[str, ...] = AGENT_START
    chat_start: tuple[str, ...] = AGENT_START[:2]
    structural: tuple[str, ...] = STRUCTURAL
    canvas_edit: tuple[str, ...] = ("block_create", "block_delete", "block_resize")
    dependency: tuple[str, ...] = DEPENDENCY
    output: tuple[str, ...] = OUTPUT
    fullscreen: tuple[str, ...] = ("fullscreen_open", "fullscreen_preview_output")
    preview: str = "fullscreen_preview_output"
    fullscreen_open: str = "fullscreen_open"
    tour_finished: str = "canvas_onboarding_tour_finished"
    form_skipped: str = "skip_onboarding_form"
    form_submitted: str = "submit_onboarding_form"
    error_assist: str = ERROR_ASSIST
    credits_exceeded: str = CREDITS_EXCEEDED
    credit_use: tuple[str, ...] = CREDIT_USE
    addon_credits: str = CREDIT_USE[1]
    credit_warnings: tuple[str, ...] = CREDIT_WARNINGS
    segments: tuple[str, ...] = SEGMENTS

    @property
    def tool_events(self) -> tuple[str, ...]:
        return tuple(self.tool_prefix + tool for tool in self.tools)

    @property
    def build_events(self) -> tuple[str, ...]:
        return tuple(self.tool_prefix + tool for tool in self.build_tools)

    @property
    def credit_events(self) -> tuple[str, ...]:
        return self.credit_use + (self.credits_exceeded,) + self.credit_warnings

    @property
    def struggle(self) -> tuple[str, ...]:
        return (self.error_assist, self.credits_exceeded) + self.credit_warnings

    @property
    def recovery(self) -> tuple[str, ...]:
        return self.runs + (self.tool_prefix + "run_block_tool",) + self.build_events + (self.preview,)


DEFAULT = Vocabulary()
