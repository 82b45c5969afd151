"""Writers and the audit trail."""
