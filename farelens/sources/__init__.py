"""Sources and sinks: native readers, zone dimension, bindings, writers."""
