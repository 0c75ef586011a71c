"""Declared schemas of the 24 register tables.

DDL strings as accepted by ``spark.read.schema``.  Identifiers are long, measures double, times zone-less timestamps (UTC).
"""

from __future__ import annotations

_STAMPS = "created_at timestamp_ntz, updated_at timestamp_ntz"

TABLES: dict[str, str] = {
    "roles": f"id long, name string, description string, {_STAMPS}",
    "users": f"id long, role_id long, name string, email string, password_hash string, is_active boolean, {_STAMPS}",
    "transporters": f"id long, name string, contact_person string, phone string, email string, is_active boolean, {_STAMPS}",
    "vehicles": f"""id long, transporter_id long, vehicle_type string, make string, model string, owner_name string,
        is_authorized boolean, status string, notes string, {_STAMPS}""",
    "vehicle_plates": f"""id long, vehicle_id long, plate_number string, is_primary boolean, state_code string,
        is_active boolean, {_STAMPS}""",
    "drivers": f"""id long, name string, license_number string, phone string, transporter_id long,
        assigned_vehicle_id long, status string, is_active boolean, {_STAMPS}""",
    "gates": f"id long, name string, code string, location string, gate_type string, status string, {_STAMPS}",
    "cameras": f"""id long, gate_id long, name string, code string, rtsp_url string, ip_address string,
        direction string, status string, is_enabled boolean, {_STAMPS}""",
    "model_versions": f"""id long, model_name string, version string, framework string, file_path string,
        is_active boolean, input_shape string, {_STAMPS}""",
    "scheduled_trips": f"""id long, trip_number string, vehicle_id long, plate_number string, driver_id long,
        driver_name string, transporter_id long, transporter_name string, gate_id long, gate_name string,
        purpose string, expected_arrival timestamp_ntz, expected_departure timestamp_ntz,
        actual_entry_time timestamp_ntz, actual_exit_time timestamp_ntz, dwell_minutes int, status string,
        notes string, {_STAMPS}""",
    "trip_status_history": """id long, trip_id long, from_status string, to_status string, changed_by_user_id long,
        trigger_event_id long, notes string, timestamp timestamp_ntz""",
    "vehicle_detections": """id long, camera_id long, gate_id long, tracking_id long, frame_number int,
        bbox_x1 double, bbox_y1 double, bbox_x2 double, bbox_y2 double, vehicle_type string, confidence double,
        detection_timestamp timestamp_ntz, created_at timestamp_ntz""",
    "plate_predictions": """id long, vehicle_detection_id long, track_id long, raw_plate_text string,
        clean_plate_text string, fused_plate_text string, confidence double, is_fused boolean, frame_count int,
        status string, camera_code string, gate_name string, created_at timestamp_ntz""",
    "plate_prediction_frames": """id long, plate_prediction_id long, frame_number int, ocr_text string,
        confidence double, crop_image_path string, engine string, timestamp timestamp_ntz""",
    "entry_exit_events": """id long, vehicle_id long, vehicle_plate_id long, gate_id long, camera_id long,
        vehicle_detection_id long, plate_prediction_id long, event_type string, plate_number string,
        vehicle_type string, transporter string, gate_name string, camera_name string, confidence double,
        decision string, is_corrected boolean, dwell_minutes int, timestamp timestamp_ntz, created_at timestamp_ntz""",
    "gate_decisions": """id long, event_id long, gate_id long, decision string, reason string, rule_matched string,
        decided_by_user_id long, is_override boolean, timestamp timestamp_ntz""",
    "whitelist_entries": """id long, vehicle_id long, plate_number string, reason string, approved_by_user_id long,
        valid_from timestamp_ntz, valid_until timestamp_ntz, is_active boolean, created_at timestamp_ntz""",
    "watchlist_entries": """id long, vehicle_id long, plate_number string, reason string, severity string,
        alert_message string, added_by_user_id long, is_active boolean, created_at timestamp_ntz""",
    "alerts": """id long, alert_type string, severity string, message string, plate_number string, vehicle_id long,
        gate_id long, gate_name string, event_id long, is_read boolean, read_at timestamp_ntz,
        resolved_at timestamp_ntz, created_at timestamp_ntz""",
    "alert_deliveries": """id long, alert_id long, channel string, recipient string, status string,
        sent_at timestamp_ntz, error_message string""",
    "audit_logs": """id long, user_id long, action string, entity_type string, entity_id string, details string,
        ip_address string, timestamp timestamp_ntz""",
    "manual_corrections": """id long, plate_prediction_id long, event_id long, original_plate string,
        corrected_plate string, operator_id long, reason string, corrected_at timestamp_ntz""",
    "camera_health": """id long, camera_id long, is_online boolean, last_successful_frame_at timestamp_ntz,
        last_check_at timestamp_ntz, response_time_ms double, error_message string, created_at timestamp_ntz""",
    "daily_gate_summary": """id long, gate_id long, summary_date date, total_entries int, total_exits int,
        total_denied int, total_reviews int, total_alerts int, avg_dwell_minutes double,
        calculated_at timestamp_ntz""",
}
