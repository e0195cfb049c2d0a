"""DataFrame operators: detection, resolution, masking, reveal, risk, sessions, images, reports."""
