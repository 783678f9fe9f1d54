"""Table schemas, as DDL strings."""

ASSETS = (
    "filename string, filepath string, size_mb double, duration double, width int, height int, "
    "codec string, fps double, has_audio boolean, status string, error string"
)
SCENES = "source string, time double"
LEVELS = "source string, time double, rms_db double"
SILENCES = "source string, start double, end double"
CUES = "source string, cue_index int, start double, end double, text string"
TRANSCRIPT_HITS = "source string, start double, end double, text string, keywords array<string>"
OBJECT_HITS = (
    "source string, start double, end double, class_name string, class_id int, count int, confidence double"
)
PROMPT_SCORE = "struct<id: string, label: string, prompt: string, intent: string, score: double>"
ADVANCED_HITS = (
    "source string, kind string, start double, end double, source_wide boolean, text string, "
    "face_count int, person_count int, event_type string, confidence double, evidence array<string>, "
    "topic string, keywords array<string>, time_seconds double, top_score double, top_label string, "
    f"labels array<string>, prompt_scores array<{PROMPT_SCORE}>, explanation string, frame string"
)
EXPLANATION = (
    "struct<kind: string, provider: string, score: double, score_dimensions: map<string, double>, "
    "suggested_action: string, labels: array<string>, reason: string>"
)
CANDIDATES = (
    "id string, source string, start double, end double, score int, action string, "
    f"labels array<string>, reasons array<string>, signals map<string, double>, ai_explanations array<{EXPLANATION}>"
)
ANNOTATIONS = (
    "ann_index long, id string, source string, start double, end double, rating string, "
    "tags array<string>, notes string"
)
DECISIONS = (
    "id string, decision string, order int, note string, score double, current_action string, "
    "source string, start double, end double, tags array<string>"
)
DETECTIONS = (
    "source string, frame int, time_seconds double, class_id int, class_name string, confidence double, "
    "bbox_norm struct<x_center: double, y_center: double, width: double, height: double>"
)
FRAME_VECTORS = "source string, time double, vector array<float>"
PROMPT_VECTORS = "profile string, id string, label string, prompt string, intent string, vector array<double>"
SELECTION_CLIPS = (
    "selection string, source string, clip_index int, label string, start string, end string, "
    "start_seconds double, end_seconds double, score int, review_order int, labels array<string>, reasons array<string>"
)
# One raw document per row: where it came from and its whole text.
DOCUMENTS = "path string, content string"
LOG_LINES = "source string, line_no long, line string"
