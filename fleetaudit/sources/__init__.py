"""Readers and writers: files, manifests, tool reports, advisories and report documents."""
