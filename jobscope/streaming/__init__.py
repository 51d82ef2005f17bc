"""Structured Streaming forms of the alarms, the quarantine and the run tracker."""
