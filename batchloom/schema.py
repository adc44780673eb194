"""Types of structured page results and of findings."""

from __future__ import annotations

PARAMETER = "struct<name:string,spec_range:string,value:string,unit:string,value_source:string,in_spec:boolean>"
CELL = "struct<col:string,spec:string,actual:string,unit:string,value_source:string>"
MEASUREMENT = f"struct<time:string,values:array<{CELL}>>"
SIGNATURE = "struct<role:string,name:string,sign_time:string>"
CHECK = "struct<item:string,selected:string,marker:string>"
STEP = (
    "struct<step_no:string,operation:string,start_time:string,end_time:string,operator:string,reviewer:string,"
    f"parameters:array<{PARAMETER}>,measurements:array<{MEASUREMENT}>,signatures:array<{SIGNATURE}>,checks:array<{CHECK}>,handwritten:array<string>>"
)
PAGE_FINDING = "struct<type:string,severity:string,description:string,ocr_text:string,operator:string>"
PAGE_INFO = "struct<title:string,file_code:string,version:string,batch_no:string,production_date:string>"
#: A page ready for the rules; every leaf scalar stays the text that was recognised.
PAGES = (
    f"job_id string, page int, page_info {PAGE_INFO}, event_year_groups map<string,array<string>>, steps array<{STEP}>, "
    f"findings array<{PAGE_FINDING}>, overall_confidence string, low_conf_cols array<string>"
)
#: ``rule`` and ``ord`` give the fixed order of rules and of a rule's rows; the others are the finding itself.
FINDINGS = "job_id string, page int, type string, severity string, description string, ocr_text string, operator string, source string, rule_id string, rule int, ord string"
FINGERPRINT = ["job_id", "source", "page", "type", "description"]

# Order of severities and sources in lists, labels, role ranks, and the order of the rules.
SEVERITIES = ["critical", "warning", "info"]
SOURCES = ["rule", "llm_fallback", "llm_page", "llm_cross"]
ROLE_RANKS = {
    "operator": 0, "操作人": 0, "操作员": 0,
    "reviewer": 1, "复核人": 1, "复核员": 1, "workshop_reviewer": 1, "issuer": 1, "记录发放": 1,
    "qa": 2, "qa_reviewer": 2, "质量保证": 2, "qa审核": 2, "批准人": 2, "放行人": 2,
}
OPERATOR_ROLES = ["operator", "操作人", "操作员"]
REVIEWER_ROLES = ["reviewer", "复核人", "复核员", "workshop_reviewer"]
QA_ROLES = ["qa", "qa_reviewer", "质量保证", "qa审核", "批准人", "放行人"]
EVENT_TYPES = ["draft", "production", "review", "approval", "issue", "other"]
RULES = ["R1a", "R1b", "R2", "R4", "R5", "R9a", "R6", "R7", "R8", "R9", "R8b", "RM1", "RM2", "R3", "PP", "FB", "SEM"]
UNREADABLE = "手写内容未识别"
