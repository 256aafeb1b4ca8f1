from linewright.cli import main

main()
