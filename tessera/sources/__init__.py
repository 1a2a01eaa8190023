"""Reading configurations and results, writing accepted rows and exports."""
